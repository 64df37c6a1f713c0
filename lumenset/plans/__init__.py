"""Registered queries with their SQL for DuckDB."""
