"""Operators over DataFrames: filters, joins, aggregates, rankings, search, graphs, corpus analytics, audits."""
