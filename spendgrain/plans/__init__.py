"""Shared marts and the batch pipeline."""
