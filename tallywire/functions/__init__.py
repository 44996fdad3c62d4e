"""Column functions: arithmetic, time, bytes, addresses, formats and code tables."""
