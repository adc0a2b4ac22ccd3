"""Operators for preparing training text, each a DataFrame in and a DataFrame out."""
