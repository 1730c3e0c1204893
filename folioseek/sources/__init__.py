"""Folders, files and records as document rows."""
