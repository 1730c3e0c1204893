"""Indexing and searching: operators put together over saved tables."""
