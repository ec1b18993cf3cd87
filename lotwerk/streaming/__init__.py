"""Structured Streaming forms of the operators that depend on time or order."""
