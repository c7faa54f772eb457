"""Experiment tables: summaries, Pareto fronts, trial settings, thinned statistics."""
