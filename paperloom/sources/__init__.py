"""Readers, writers and key-based data changes."""
