"""Readers with fixed schemas, and the sample sink."""
