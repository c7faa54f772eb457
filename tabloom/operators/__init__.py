"""Table operators: shaping, joins, caps, dates and reversible column encoders."""
