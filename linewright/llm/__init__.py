"""Operators that a large training-data pipeline needs, one module each.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries of these operators and, where SQL can express them, their SQL.
"""
