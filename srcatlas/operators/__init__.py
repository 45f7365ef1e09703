"""Relational, graph and search operators over the index tables."""
