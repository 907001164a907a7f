"""Readers and writers of tables and exchange formats."""
