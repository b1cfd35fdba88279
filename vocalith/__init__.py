"""vocalith: a PySpark-native analytics engine for speech and voice-agent evaluation."""
