"""Relational plans over the library's tables, and their shapes on any table."""
