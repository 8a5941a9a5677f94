"""Composed analyses and the registered query catalog."""
