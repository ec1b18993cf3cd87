"""Operators on training text and matched records; nothing outside this subpackage imports it."""
