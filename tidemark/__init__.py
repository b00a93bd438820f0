"""Spark-first segmentation of long ordered signals, with a result and task store."""
