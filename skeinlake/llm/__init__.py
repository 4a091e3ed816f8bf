"""Operators for text and media corpora; nothing else in the package imports them."""
