"""Column expressions shared by the queries."""
