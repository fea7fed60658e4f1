"""End-to-end jobs, and the queries registered for the driver."""

from importlib import import_module

MODULES = ("select_queries", "aggregate_queries", "window_queries", "join_queries", "space_queries", "source_queries", "stream_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict:
    from cirrostrat.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracles() -> dict:
    from cirrostrat.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
