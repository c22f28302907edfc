"""Operators for large training corpora. Nothing else in this library imports them."""
