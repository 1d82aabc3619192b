"""Bulk analytics over captured web pages, written for Spark."""
