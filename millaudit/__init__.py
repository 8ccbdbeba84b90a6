"""Spark-native audit of parsed food inspection reports."""
