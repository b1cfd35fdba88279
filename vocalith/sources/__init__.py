"""Part of vocalith: sources."""
