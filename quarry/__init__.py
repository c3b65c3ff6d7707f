"""quarry: corpus indexing and hybrid retrieval as Spark DataFrame operators."""
