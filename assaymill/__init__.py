"""Spark-first analytics for labelled sample-by-feature matrices."""
