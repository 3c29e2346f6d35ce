"""wardline: Spark-native civic data analytics (DataFrame in, DataFrame out)."""
