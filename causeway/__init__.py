"""Causeway: causal event-sequence analytics as PySpark DataFrame plans."""
