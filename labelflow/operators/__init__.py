"""Sampling, splitting, filtering, quality, judging and classification."""
