"""tidemark: auction-catalogue analytics as Spark DataFrame operators."""
