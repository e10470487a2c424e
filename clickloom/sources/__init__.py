"""Readers, writers and connectors. Operators never do I/O themselves."""
