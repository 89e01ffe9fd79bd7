"""Operators that prepare text and rankings for training language models."""
