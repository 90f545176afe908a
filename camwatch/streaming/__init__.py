"""camwatch streaming."""
