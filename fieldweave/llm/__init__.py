"""Operators for large-scale training data: each one a function from DataFrame to DataFrame."""
