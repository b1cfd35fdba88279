"""Part of vocalith: functions."""
