"""Relational, spatial, graph and model operators on DataFrames."""
