"""Captures, rules and landed responses."""
