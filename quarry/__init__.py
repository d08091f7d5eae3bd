"""quarry: a Spark-native engine for running SQL and for mining SQL workloads."""
