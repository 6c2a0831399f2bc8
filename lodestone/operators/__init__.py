"""Relational, retrieval, graph and federation operators: DataFrame in, DataFrame out."""
