"""Whole queries: operators put together over the projection, and their SQL equivalents."""
