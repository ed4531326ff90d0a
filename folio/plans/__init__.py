"""User-level jobs and the registered query catalog."""
