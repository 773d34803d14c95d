"""Versioned key-value tables and boolean full-text search as DataFrame operations."""
