"""loam: a Spark-first engine for document retrieval and knowledge-graph analytics."""
