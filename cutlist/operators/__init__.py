"""operators of cutlist."""
