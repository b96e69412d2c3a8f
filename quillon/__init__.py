"""A Spark-native engine for learning and analytics over DataFrames."""
