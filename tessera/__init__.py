"""Spark-first governance analytics: sources, scalar functions, operators, plans and streaming ingest."""
