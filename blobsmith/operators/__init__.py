"""Operators over listings of archive entries, as DataFrame operations."""
