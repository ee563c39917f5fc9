"""wayline: a Spark-native engine for moving-object trajectories."""
