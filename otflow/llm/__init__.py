"""Operators that prepare text corpora; nothing else in the package imports them."""
