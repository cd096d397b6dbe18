"""Readers, writers and the pluggable recogniser."""
