"""Sources of the grounded-dialogue pipeline."""
