"""Readers, text/markup/JSON record extraction, writers."""
