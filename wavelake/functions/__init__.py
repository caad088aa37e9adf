"""Subpackage of the trace engine."""
