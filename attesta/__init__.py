"""Evidence retrieval and governance analytics as Spark DataFrame plans."""
