"""Chunk planners and whole-query plans."""
