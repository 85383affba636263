"""Operators for building training corpora: deduplication, scoring, filtering, tokens and vectors."""
