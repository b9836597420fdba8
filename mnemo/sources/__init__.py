"""mnemo.sources."""
