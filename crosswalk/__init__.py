"""Aligning one data model's vocabulary to another's, as DataFrame operations on Spark."""
