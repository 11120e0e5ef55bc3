"""Operators that a large training-data pipeline needs.

Nothing outside this subpackage imports it; it imports nothing from the rest of
the library either, so either side can be removed without the other noticing.
"""
