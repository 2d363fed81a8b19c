"""Operators on text and event sequences for training data. Nothing else in the library imports this package."""
