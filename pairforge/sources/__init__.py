"""Readers, importers and write-once stages."""
