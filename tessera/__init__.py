"""A Spark-native engine for hybrid retrieval and knowledge-graph analytics over documents and source code."""
