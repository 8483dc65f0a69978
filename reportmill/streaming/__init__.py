"""Transcripts as they arrive. What an operator does within one document needs no state, so it runs on streams as on tables."""
