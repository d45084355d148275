"""Connectors: where answers come from."""
