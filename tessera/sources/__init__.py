"""Where rows come from: a catalog of DataFrames, and request-based analytics providers."""
