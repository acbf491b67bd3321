"""Readers, writers and views of trade data."""
