"""Prepare job: raw flow columns to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.operators import features, schema
from flowloom.operators.packets import join_header_bytes, join_plaintext
from flowloom.settings import PLAINTEXT_FEATURES, Settings


def prepare(
    raw: DataFrame,
    cfg: Settings | None = None,
    plaintext: DataFrame | None = None,
    header_bytes: DataFrame | None = None,
    allow_missing: bool = False,
    group_limit: int | None = None,
) -> DataFrame:
    """Normalized flows (with ``row_id``) to prepared flows, as one lazy plan.

    ``plaintext`` and ``header_bytes`` are optional per-flow packet tables.
    """
    cfg = cfg or Settings()
    schema.raise_errors(schema.check_critical(raw, allow_missing))
    df = features.enrich(schema.complete_schema(raw), group_limit)
    if plaintext is not None:
        df = join_plaintext(df, plaintext)
    else:
        df = df.withColumns({c: F.lit(0.0) for c in PLAINTEXT_FEATURES if c not in df.columns})
    if header_bytes is not None:
        df = join_header_bytes(df, header_bytes)
    return schema.select_prepared(df, cfg)
