"""End-to-end plans: build, search, similar, presentation."""
