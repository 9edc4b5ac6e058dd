"""Operators over DataFrames: fields, matching, readings, proposals, graphs, sweeps, modules."""
