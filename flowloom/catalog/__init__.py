"""Registered queries and their SQL counterparts on the given tables."""

from flowloom.catalog.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from flowloom.catalog import (  # noqa: F401  (importing registers the queries)
        alerts,
        features,
        governance,
        models,
        packets,
        siem,
        sources,
        streams,
        traffic,
    )

    return QUERIES, ORACLES
