"""Column functions: date and width buckets, text search."""
