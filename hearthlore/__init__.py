"""Hearthlore: grounded-dialogue analytics and corpus preparation on Spark DataFrames."""
