"""Readers and writers of content tables."""
