"""Operators that prepare text, pages and vectors as training data for language models."""
