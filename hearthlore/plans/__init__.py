"""Plans of the grounded-dialogue pipeline."""
