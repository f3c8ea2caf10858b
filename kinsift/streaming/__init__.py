"""Incremental scoring of arriving records against a fixed reference table."""
