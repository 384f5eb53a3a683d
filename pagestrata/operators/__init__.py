"""Operators over page corpora."""
