"""Spark-native analytics over form catalogues, registers and their histories."""
