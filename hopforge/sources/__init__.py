"""Readers and writers of tables and of raw little-endian vector files."""
