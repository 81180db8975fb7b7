"""CSV sources and the stored catalogue."""
