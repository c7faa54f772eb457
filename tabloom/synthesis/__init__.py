"""Synthetic rows: a small variational network and a Gaussian copula."""
