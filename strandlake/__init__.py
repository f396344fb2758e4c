"""Sequence analytics on Spark: sources, column functions, operators and plans."""
