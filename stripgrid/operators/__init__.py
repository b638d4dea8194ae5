"""Operators on row and block matrices."""
