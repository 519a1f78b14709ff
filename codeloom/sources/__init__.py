"""Readers of tables and source trees, and shared scratch tables."""
