"""Readers, normalization and table mappings."""
