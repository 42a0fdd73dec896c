"""loomdex: a Spark-native web-index and text analytics engine."""
