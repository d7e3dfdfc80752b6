"""Operators on text corpora and streams of training data; nothing outside imports this package."""
