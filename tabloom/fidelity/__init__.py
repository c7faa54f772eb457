"""Metrics that compare a real and a synthetic table."""
