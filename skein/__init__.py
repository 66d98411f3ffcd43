"""skein: a Spark-native hybrid search and text-processing engine."""
