"""Operators for large training-text collections, one module per operator.

Nothing outside this package imports it; ``queries.py`` registers one query
per operator and ``corpus_pipeline.py`` at the repository top chains five.
"""
