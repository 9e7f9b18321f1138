"""Operators for building large text corpora."""
