"""tidemark: market-data analytics as Spark DataFrame operators."""
