"""Composed plans: context assembly, graph documents and the queries with their oracles."""
