"""Operators on hypergraphs and graphs."""
