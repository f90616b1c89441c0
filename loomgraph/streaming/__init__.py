"""Event streams: windows, deduplication and latest state, with batch equivalents."""
