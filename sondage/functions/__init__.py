"""Column functions and small pure-Python helpers."""
