"""Spark-native search and discovery analytics."""
