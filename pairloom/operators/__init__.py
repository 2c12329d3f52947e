"""Relational, text, graph and model operators: DataFrame in, DataFrame out."""
