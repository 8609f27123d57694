"""Readers and writers for the tables and documents of a study."""
