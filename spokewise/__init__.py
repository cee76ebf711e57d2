"""Safety-weighted road-network analytics expressed as Spark DataFrame plans."""
