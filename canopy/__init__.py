"""Hierarchical dependency analytics expressed as Spark DataFrame plans."""
