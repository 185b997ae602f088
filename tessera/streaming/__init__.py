"""Every graph operator is a batch job; incremental runs use the sample flags of
``operators.graph.progressive_graph``, so nothing here needs a stream."""
