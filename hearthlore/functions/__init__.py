"""Functions of the grounded-dialogue pipeline."""
