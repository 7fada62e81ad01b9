"""sources of the evidence-graph engine."""
