"""Configured stages built from operators."""
