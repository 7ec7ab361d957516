"""Operators for preparing training text. Nothing else in the library imports this package."""
