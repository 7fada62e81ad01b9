"""plans of the evidence-graph engine."""
