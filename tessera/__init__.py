"""Dimension/metric analytics on Spark: GraphQL-style documents compiled to DataFrame plans."""
