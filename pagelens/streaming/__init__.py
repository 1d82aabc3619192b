"""The detectors over a stream of captures."""
