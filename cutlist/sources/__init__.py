"""sources of cutlist."""
