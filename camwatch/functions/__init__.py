"""camwatch functions."""
