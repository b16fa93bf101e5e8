"""Operators for preparing training text: duplicates, tokens, quality, secrets, mixing."""
