"""Fitted encoders and statistic thinning on streams."""
