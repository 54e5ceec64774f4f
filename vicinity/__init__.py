"""vicinity: a Spark-native nearest-neighbour decision engine."""
