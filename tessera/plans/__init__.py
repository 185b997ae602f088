"""Whole jobs: the registered queries, their SQL, and threshold sweeps."""
