"""Whole pipelines, the registered queries and the command line."""
