"""File formats: distributed scans and sinks."""
