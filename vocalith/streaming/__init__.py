"""Part of vocalith: streaming."""
