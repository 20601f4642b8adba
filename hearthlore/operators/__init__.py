"""Operators of the grounded-dialogue pipeline."""
