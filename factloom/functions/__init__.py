"""functions of the evidence-graph engine."""
