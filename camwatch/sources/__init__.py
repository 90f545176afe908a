"""camwatch sources."""
