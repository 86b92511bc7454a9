"""Readers and writers of corpora, models and results."""
