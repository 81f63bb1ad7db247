"""Mixing sources to target weights by Poisson replication.

A source with n rows that shall hold the share w of a mixture of N rows has the
target rate w * N / n. A hash of the document, read as a uniform number, goes through
the inverted Poisson distribution of that rate and gives the number of copies: no
random state, so a task that runs again gives the same rows. Copies are spread over
all partitions by a hash of document and copy and sorted by it within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.common import col, fresh, partitions
from flowloom.operators.skew import lookup

SEED = 42
STEP = 64.0  # larger rates are sums of independent draws, so exp() never underflows
PLACES = 200  # thresholds of one draw; the rest of the distribution is below 2**-53


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) with 52 bits, from a hash of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of a Poisson variable at 0, 1, 2, ..."""
    first = F.exp(-rate)
    zero = F.struct(first.alias("p"), F.array(first).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(PLACES)),
        zero,
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"),
        ),
        lambda acc: acc["c"],
    )


def source_rates(docs: DataFrame, weights: dict[str, float] | None, by: str = "source") -> DataFrame:
    """(source, draws, steps): one row for each source, over all rows of ``docs``.

    Without weights every source gets the same share. With weights, sources that
    have none (the null source too) are left out of the mixture.
    """
    counts = docs.groupBy(col(by).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(_all())
    if weights is None:
        target = total.cast("double") / (F.count(F.lit(1)).over(_all()) * F.col("_n"))
    else:
        whole = float(sum(weights.values()))
        share = F.lit(0.0)
        for name, w in sorted(weights.items()):
            share = F.when(F.col("_source") == name, F.lit(float(w) / whole)).otherwise(share)
        target = share * total.cast("double") / F.col("_n")
    rates = counts.withColumn("_rate", target)
    draws = F.greatest(F.ceil(F.col("_rate") / STEP), F.lit(1)).cast("int")
    return rates.select(
        "_source", draws.alias("_draws"), poisson_steps(F.col("_rate") / draws).alias("_steps")
    )


def _all():
    return Window.partitionBy(F.lit(0))  # over one row for each source


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, by: str = "source",
    copy: str | None = None, key: str | None = None,
) -> DataFrame:
    """Rows of ``docs`` repeated to the target weights and shuffled, all columns kept.

    ``copy`` and ``key`` name columns for the number of the copy and the shuffle key.
    Rows that share a doc_id share their number of copies; a null doc_id or source
    counts as a value of its own. Weights of 0 leave a source out.
    """
    copy_name, key_name = copy or fresh(docs, "copy"), key or fresh(docs, "shuffle_key")
    src, draws, steps, copies_name = (fresh(docs, n) for n in ("_source", "_draws", "_steps", "_copies"))
    rates = source_rates(docs, weights, by).toDF(src, draws, steps)
    rated = lookup(docs.withColumn(src, col(by)), rates, [src], row_bytes=8 * PLACES + 64)
    draw = lambda j: _place(uniform(F.lit(seed), col("doc_id"), j), col(steps))
    copies = F.when(col(draws) == 1, draw(F.lit(1))).otherwise(
        F.aggregate(F.sequence(F.lit(1), col(draws)), F.lit(0), lambda acc, j: acc + draw(j))
    )
    repeated = (
        rated.withColumn(copies_name, copies)
        .filter(col(copies_name) > 0)
        .withColumn(copy_name, F.explode(F.sequence(F.lit(1), col(copies_name))))
    )
    text = F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(col("doc_id").cast("string"), F.lit("null")), col(copy_name))
    keyed = repeated.withColumn(key_name, F.substring(F.md5(text.cast("binary")), 1, 16))
    mixed = keyed.repartition(partitions(docs), key_name).sortWithinPartitions(key_name)
    kept = [*docs.columns, *([copy_name] if copy else []), *([key_name] if key else [])]
    return mixed.select(*[col(c) for c in kept])


def _place(u: Column, steps: Column) -> Column:
    """Number of thresholds at or below u, which is computed once."""
    return F.size(F.transform(F.array(u), lambda x: F.filter(steps, lambda c: c <= x))[0])
