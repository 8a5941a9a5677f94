"""Sequence-variation analytics as Spark jobs."""
