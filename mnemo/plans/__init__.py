"""mnemo.plans."""
