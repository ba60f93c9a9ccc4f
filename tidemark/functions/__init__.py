"""Code labels, clocks and small column helpers."""
