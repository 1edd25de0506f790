"""Operators that prepare texts and vectors for the training of language models; nothing outside imports this."""
