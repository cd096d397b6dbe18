"""Operators on timed transcripts: chunk pairs, word runs, merges."""
