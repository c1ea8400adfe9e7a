"""Operators that need more than a column expression."""
