"""Readers of uploaded files."""
