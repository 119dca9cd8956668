"""Scalar functions as Spark columns and as plain Python."""
