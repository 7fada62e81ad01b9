"""streaming of the evidence-graph engine."""
