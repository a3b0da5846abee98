"""Pseudoalignment data on Spark: parse, resolve, combine, render and store sparse query-target matrices."""
