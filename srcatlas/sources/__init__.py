"""Scans that turn source trees into DataFrames, and snapshot sinks."""
