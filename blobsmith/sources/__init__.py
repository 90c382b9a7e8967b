"""Readers and writers of archives."""
