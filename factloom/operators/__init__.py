"""operators of the evidence-graph engine."""
