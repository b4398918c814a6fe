"""Relational operators that need more than one call of the DataFrame API."""
