"""Header blocks: values, means, quality and the channel that reads them, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from flowloom.operators import models, packets
from flowloom.settings import Settings

WIDTH = packets.HEADER_WIDTH


def blocks(spark, rows=40):
    rng = np.random.default_rng(7)
    held = [bytes(rng.integers(0, 256, WIDTH, dtype=np.uint8)) if i % 4 else bytes(WIDTH) for i in range(rows)]
    held = [None if i == 5 else b for i, b in enumerate(held)]
    df = spark.createDataFrame(
        [(i, None if b is None else bytearray(b), i % 2) for i, b in enumerate(held)], "id int, header_bytes binary, is_attack int")
    return df, [bytes(WIDTH) if b is None else b for b in held]


def test_scaled_values_means_and_quality(spark):
    df, held = blocks(spark)
    got = df.select("id", packets.scaled_header(F.col("header_bytes")).alias("v"),
                    models.header_features(F.col("header_bytes")).alias("m")).orderBy("id").collect()
    for row, b in zip(got, held):
        values = [float(np.float32(x / 255.0)) for x in b]
        assert list(row["v"]) == values
        assert list(row["m"]) == [sum(values[i:i + 16]) / 16 for i in range(0, WIDTH, 16)]
    q = packets.header_quality(df).first()
    x = np.array([list(b) for b in held]) / 255.0
    assert q["nonzero_fraction"] == round(float((x != 0).mean()), 8) and q["columns_present"] == WIDTH
    assert abs(q["variance_mean"] - x.var(axis=0, ddof=1).mean()) < 1e-12 and q["signal_quality"] == "good"
    assert packets.header_quality(df.limit(0)).first()["signal_quality"] == "constant_or_empty"


def test_header_channel_scores_blocks(spark):
    """The scores were an error before, as the means were a lambda below a Python function."""
    df, _ = blocks(spark)
    rows = df.withColumn("flow_key", F.col("id").cast("string"))
    ch = models.fit_header(rows, Settings(forest_trees=4), trees=4)
    scored = ch.score(rows).select("flow_key", F.round(ch.out, 6).alias("score")).collect()
    assert len(scored) == 40 and all(0 <= r.score <= 1 for r in scored)
    assert models.fit_header(df.filter("header_bytes is null"), Settings()) is None
