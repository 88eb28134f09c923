"""Operators for building training data: text, vectors, pages and conversations."""
