"""Trapline: deceptive-design analytics as Spark DataFrame operators."""
