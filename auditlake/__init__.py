"""Transcript compliance analytics as Spark DataFrame operators."""
