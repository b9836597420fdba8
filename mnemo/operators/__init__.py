"""mnemo.operators."""
