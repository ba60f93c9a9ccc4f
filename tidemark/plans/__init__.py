"""Canonical inputs, registered queries and their SQL."""
