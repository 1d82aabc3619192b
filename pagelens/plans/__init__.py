"""Aggregations over findings: risk, history and reports."""
