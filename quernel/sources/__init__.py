"""Columnar file scans, sinks and metadata."""
