"""Joins, clustering, comparison and quality tests over profile tables."""
