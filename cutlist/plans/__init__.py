"""plans of cutlist."""
