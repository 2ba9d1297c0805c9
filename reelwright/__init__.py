"""Spark-first engine for content timelines: detect, segment, resolve, pack and play."""
