"""Part of vocalith: operators."""
