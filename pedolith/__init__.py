"""Spark-native analytics for gridded environmental data, point observations and soil profiles."""
