"""Differential privacy: Renyi accounting, clipping, noisy sums, Poisson sampling."""
