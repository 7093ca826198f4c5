"""Operators for preparing language-model training text (see queries.py for the registered ones)."""
