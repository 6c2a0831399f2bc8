"""lodestone: code and document retrieval analytics as Spark plans."""
