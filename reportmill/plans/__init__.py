"""Whole routes: from transcripts to records and run reports."""
