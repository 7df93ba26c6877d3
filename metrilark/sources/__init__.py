"""Readers of datasets and evaluation files, and recorders of results."""
