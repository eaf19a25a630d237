"""Operators for training text and embeddings. Nothing outside this folder imports it."""
