"""Skein: retrieval, knowledge-graph and agent-trace analytics as PySpark DataFrame plans."""
