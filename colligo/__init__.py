"""Spark-native analytics and learning over column-partitioned tables."""
