"""Document privacy analytics expressed as Spark plans."""
