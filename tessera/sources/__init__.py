"""Readers of feature and cluster text, bindings to relational tables, and sinks."""
