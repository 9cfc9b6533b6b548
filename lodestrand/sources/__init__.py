"""Tables from text lines, and scratch tables."""
