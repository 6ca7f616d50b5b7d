"""functions of cutlist."""
