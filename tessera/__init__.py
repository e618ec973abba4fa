"""tessera: a Spark-native data-mining engine."""
