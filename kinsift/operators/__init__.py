"""Blocking, embedding, partitioning, neighbours, pairs, similarity and clusters."""
