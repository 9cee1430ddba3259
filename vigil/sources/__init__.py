"""Scans, stand-in views over the driver tables, sinks and snapshot writes."""
