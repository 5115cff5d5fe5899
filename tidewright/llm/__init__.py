"""Operators for building training data from raw text. Nothing else in the library imports this subpackage."""
