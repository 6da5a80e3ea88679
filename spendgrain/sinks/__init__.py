"""Writing tables, marts and reports."""
