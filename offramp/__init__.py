"""Spark-native data work for language models that can stop at an intermediate layer."""
