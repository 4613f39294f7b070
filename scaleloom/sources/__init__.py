"""Readers that give records, schema inference, and writers."""
