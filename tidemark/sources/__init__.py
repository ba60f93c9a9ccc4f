"""Readers of exchange files and derived tables, and sinks."""
