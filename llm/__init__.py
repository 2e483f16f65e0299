"""Operators for building training corpora. Nothing else in this repository imports this package."""
