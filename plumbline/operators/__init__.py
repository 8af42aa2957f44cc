"""DataFrame operators; each carries ``graph_id`` or another grouping key, so one job serves many projects."""
