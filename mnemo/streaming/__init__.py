"""mnemo.streaming."""
