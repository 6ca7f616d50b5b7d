"""streaming of cutlist."""
