"""Part of docloom."""
