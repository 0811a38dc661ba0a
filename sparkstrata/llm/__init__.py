"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage, so it can be removed as a
whole.
"""
