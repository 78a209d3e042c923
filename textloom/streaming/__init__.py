"""Structured streaming over arriving dumps."""
