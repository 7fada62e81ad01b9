"""Evidence-graph analytics as Spark DataFrame plans."""
