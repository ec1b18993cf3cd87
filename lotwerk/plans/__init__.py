"""Queries composed of the operators, each with the SQL it must agree with."""
