"""Operators for large training-data pipelines (filters, near-duplicates, tokens, models).

Nothing else in the library imports this subpackage; each module is usable alone.
"""
