"""mnemo.functions."""
