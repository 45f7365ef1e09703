"""Composite plans and the registered query catalogue."""
