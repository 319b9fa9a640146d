"""Spark jobs that cluster entities by profile similarity and judge the clusterings."""
