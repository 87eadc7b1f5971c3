"""Queries over the test tables, with their DuckDB twins."""

_MODULES = [
    "retrieval_queries", "graph_queries", "review_queries", "text_queries", "ingest_queries", "cluster_queries", "stream_queries",
]


def load():
    """The registry with every query module imported."""
    from importlib import import_module

    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
