"""Scans, sinks, row ids, feature detection and synthetic records."""
