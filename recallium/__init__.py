"""Recallium: retrieval, scoring and knowledge-graph analytics over memory tables on Spark."""
