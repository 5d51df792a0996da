"""Operators for building training data from text: one module per operator, queries beside them."""
