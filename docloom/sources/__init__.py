"""Sources of docloom."""
