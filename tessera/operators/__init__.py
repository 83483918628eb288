"""Predicates, joins, metrics, levels, operators between results, and result shapes."""
