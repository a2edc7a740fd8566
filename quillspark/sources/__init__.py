"""Readers, writers, shards and connectors."""
