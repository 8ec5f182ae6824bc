"""Operators of docloom."""
