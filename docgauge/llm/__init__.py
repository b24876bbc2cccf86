"""Operators on training data for language models and their queries."""
