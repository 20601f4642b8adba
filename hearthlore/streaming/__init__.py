"""Streaming of the grounded-dialogue pipeline."""
