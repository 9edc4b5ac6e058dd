"""Scalar functions as Spark columns, and lexers of source text."""
