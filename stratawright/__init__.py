"""Spark-native engine for dynamic-candidate routing benchmarks and corpus preparation."""
