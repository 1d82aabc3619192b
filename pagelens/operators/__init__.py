"""Detectors and enrichments: captures in, findings out."""
