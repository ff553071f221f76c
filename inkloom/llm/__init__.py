"""Operators for large-scale training data; nothing else in inkloom imports this package."""
