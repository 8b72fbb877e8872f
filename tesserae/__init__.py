"""Spark-native matching of pictures, records and documents."""
