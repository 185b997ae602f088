"""Weights, indexes, candidates and graphs as DataFrame operators."""
