"""Readers of tables and models, writers of results."""
