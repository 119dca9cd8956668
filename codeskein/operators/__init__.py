"""Relational, graph and skew-handling operators."""
