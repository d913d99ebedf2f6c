"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` and
``oracles.py`` register its queries.
"""
