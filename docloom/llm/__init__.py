"""Operators for training data from text; nothing else in docloom imports this."""
