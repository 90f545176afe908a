"""camwatch operators."""
