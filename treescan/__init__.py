"""Spark-first inventory and analytics over very large hierarchical namespaces."""
