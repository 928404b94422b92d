"""Meridian: model-evaluation, drift and retrieval analytics as Spark DataFrame operators."""
