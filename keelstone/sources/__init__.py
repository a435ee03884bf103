"""Readers and writers of change logs and table folders."""
