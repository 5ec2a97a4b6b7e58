"""Operators for building training text: cleaning, de-duplication, tokens, packing."""
