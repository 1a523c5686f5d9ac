"""Readers and writers of the directory's files."""
