"""Readers and writers of dumps, indexes and corpora."""
