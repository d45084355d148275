"""Chunk plans."""
