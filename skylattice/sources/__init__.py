"""Readers of files, logs and image headers, and sinks."""
