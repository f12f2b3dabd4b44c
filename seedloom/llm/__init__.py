"""Operators for large-scale training-text work; nothing else in the library imports this subpackage."""
