"""Level-2 channels as Spark ML models.

Every channel is a fitted pipeline plus the feature preparation it was trained
with; scoring adds one column and keeps all rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import (
    PCA,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.functions import scoring
from flowloom.functions.cleaning import attack_class, name
from flowloom.operators import forest
from flowloom.operators.isolation import bounded, feature_array
from flowloom.operators.packets import stride_means
from flowloom.operators.skew import exact_quantile, trailing_frame
from flowloom.session import materialize
from flowloom.settings import CHANNELS, PACKET_FEATURES, PACKETS_PER_FLOW, Settings

HEADER_STRIDE = 16
LEAST_HEADER_COLUMNS = 8
CLASSES = ("ATTACK", "BENIGN")  # a label is the position here
FORESTS = ("forest", "header")  # kinds whose model is a forest


@dataclass
class Channel:
    """A fitted channel: what it reads, its pipeline and its output column."""

    kind: str
    out: str
    features: list[str]
    pipeline: PipelineModel | forest.HistogramForest
    options: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        return _SCORERS[self.kind](self, df)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        if isinstance(self.pipeline, forest.HistogramForest):
            self.pipeline.save(spark, f"{path}/pipeline")
        else:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = {"kind": self.kind, "out": self.out, "features": self.features, "options": self.options}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(
            f"{path}/meta"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> Channel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        place = f"{path}/pipeline"
        grown = meta["kind"] in FORESTS
        return Channel(pipeline=forest.HistogramForest.load(spark, place) if grown else PipelineModel.load(place), **meta)


def with_class(df: DataFrame) -> DataFrame:
    flag = F.col("is_attack") if "is_attack" in df.columns else None
    named = attack_class(flag, name("Label") if flag is None else None)
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), named) - 1
    return df.withColumns({"_class": named, "label": place.cast("double")})


def vector(column: Column) -> Column:
    return array_to_vector(column)


def _only_label(df: DataFrame, features: Column) -> DataFrame:
    return with_class(df).select("label", features.alias("features"))


def _probability_score(ch: Channel, df: DataFrame) -> DataFrame:
    """Attack probability of prepared rows (those without ``features`` score 0)."""
    out = ch.pipeline.transform(df)
    p = scoring.attack_probability(vector_to_array("probability"), CLASSES)
    extra = [c for c in out.columns if c not in df.columns] + ["features"]
    return out.withColumn(ch.out, p).drop(*dict.fromkeys(extra))


def _fit(stages: list, data: DataFrame) -> PipelineModel:
    """Fitting passes over its input many times, so the prepared input is kept."""
    kept = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()


# --- random forest on the numeric block ---


def _grown(df: DataFrame, x: Column, cfg: Settings, trees: int, depth: int) -> forest.HistogramForest:
    if not 1 <= depth <= 30:
        raise ValueError(f"trees can be 1 to 30 levels deep, not {depth}")
    labelled = with_class(df)
    attack = F.col("label") == CLASSES.index("ATTACK")
    return forest.fit(labelled, x, attack, trees, depth, cfg.seed)


def fit_forest(df: DataFrame, features: list[str], cfg: Settings) -> Channel:
    """Every tree has a bag as large as the number of labelled rows."""
    grown = _grown(df, feature_array(features), cfg, cfg.forest_trees, cfg.forest_depth)
    return Channel("forest", CHANNELS["rf"], features, grown)


def _score_forest(ch: Channel, df: DataFrame) -> DataFrame:
    return ch.pipeline.score(df, feature_array(ch.features), ch.out)


# --- reconstruction error of benign traffic ---


def reconstruction_error(scaled: Column, projected: Column) -> Column:
    """Mean squared error of a projection on orthonormal axes: |x|² − |Pᵀx|²."""

    def squared(v: Column) -> Column:
        return F.aggregate(vector_to_array(v), F.lit(0.0), lambda a, x: a + x * x)

    width = F.size(vector_to_array(scaled))
    return F.greatest(squared(scaled) - squared(projected), F.lit(0.0)) / width


def fit_reconstruction(
    df: DataFrame, features: list[str], cfg: Settings, limit: int | None = None
) -> Channel:
    """Scaling and principal axes of benign rows; cut-off at their 95 % error."""
    k = max(1, min(cfg.encoding_dim, len(features) // 2))
    stages = [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        PCA(k=k, inputCol="scaled", outputCol="projected"),
    ]
    benign = with_class(df).filter("_class = 'BENIGN'").select(
        vector(feature_array(features)).alias("features")
    )
    ch = Channel("reconstruction", CHANNELS["ae"], features, _fit(stages, benign))
    errors = materialize(
        ch.pipeline.transform(benign).select(
            reconstruction_error(F.col("scaled"), F.col("projected")).alias("mse")
        )
    )
    ch.options["threshold"] = exact_quantile(errors, "mse", 0.95, limit)
    return ch


def _score_reconstruction(ch: Channel, df: DataFrame) -> DataFrame:
    out = ch.pipeline.transform(df.withColumn("features", vector(feature_array(ch.features))))
    mse = reconstruction_error(F.col("scaled"), F.col("projected"))
    return (
        out.withColumn("l2_ae_mse", mse)
        .withColumn(ch.out, scoring.reconstruction_ratio(F.col("l2_ae_mse"), float(ch.options["threshold"])))
        .drop("features", "scaled", "projected")
    )


# --- sequences of consecutive rows ---


def sequence_windows(
    df: DataFrame,
    features: list[str],
    rows: int,
    keys: list[str] | None = None,
    order: tuple[str, ...] = ("Timestamp", "row_id"),
    limit: int | None = None,
) -> DataFrame:
    """Rows with ``window``: the last ``rows`` feature vectors, null before that many.

    ``keys`` keeps windows inside a group (per source, the default of the
    sequence channel); no keys gives the single global sequence.
    """
    vectors = df.withColumn("_x", feature_array(features))
    gathered = trailing_frame(
        vectors, keys or [], list(order), rows - 1, {"_w": lambda w: F.collect_list("_x").over(w)}, limit
    )
    return gathered.withColumn("window", F.when(F.size("_w") == rows, F.col("_w"))).drop("_w", "_x")


def _sequence_features(
    df: DataFrame, features: list[str], rows: int, keys: list[str], limit: int | None
) -> DataFrame:
    """Window mean, last value and change of every feature, by window aggregates."""
    outputs = {"_rows": lambda w: F.count(F.lit(1)).over(w)}
    for i, c in enumerate(features):
        value = bounded(name(c))
        outputs[f"_mean{i}"] = lambda w, v=value: F.avg(v).over(w)
        outputs[f"_first{i}"] = lambda w, v=value: F.first(v).over(w)
    framed = trailing_frame(df, keys, ["Timestamp", "row_id"], rows - 1, outputs, limit)
    parts = []
    for i, c in enumerate(features):
        value = bounded(name(c))
        parts += [F.col(f"_mean{i}"), value, value - F.col(f"_first{i}")]
    full = F.col("_rows") == rows
    return framed.withColumns(
        {"features": vector(F.array(*parts)), "_full": full}
    ).drop("_rows", *[f"_{s}{i}" for i in range(len(features)) for s in ("mean", "first")])


def fit_sequence(
    df: DataFrame, features: list[str], cfg: Settings, keys: list[str] | None = None, limit: int | None = None
) -> Channel:
    keys = ["Source IP"] if keys is None else keys
    data = _sequence_features(with_class(df), features, cfg.window_rows, keys, limit).filter("_full")
    stages = [
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=cfg.fit_iterations, standardization=True),
    ]
    model = _fit(stages, data.select("label", "features"))
    return Channel(
        "sequence", CHANNELS["lstm"], features, model, {"rows": cfg.window_rows, "keys": keys}
    )


def _score_sequence(ch: Channel, df: DataFrame) -> DataFrame:
    """Scores of the window's last row; rows without a full window score 0."""
    data = _sequence_features(df, ch.features, ch.options["rows"], ch.options["keys"], None)
    scored = _probability_score(ch, data)
    return scored.withColumn(ch.out, F.when(F.col("_full"), F.col(ch.out)).otherwise(0.0)).drop("_full")


# --- port and protocol categories with the numeric block ---


def fit_categorical(df: DataFrame, features: list[str], cfg: Settings) -> Channel:
    """Categories enter by one-hot vectors, values never seen as their own slot."""
    text = {"_port": name("Destination Port"), "_proto": name("Protocol")}
    prepared = with_class(df).withColumns({k: v.cast("string") for k, v in text.items()})
    prepared = prepared.withColumn("numbers", vector(feature_array(features)))
    encoder = Pipeline(
        stages=[
            StringIndexer(inputCols=["_port", "_proto"], outputCols=["_porti", "_protoi"], handleInvalid="keep"),
            OneHotEncoder(inputCols=["_porti", "_protoi"], outputCols=["_portv", "_protov"], dropLast=False),
            StandardScaler(inputCol="numbers", outputCol="_scaled", withMean=True),
            VectorAssembler(inputCols=["_portv", "_protov", "_scaled"], outputCol="features"),
        ]
    ).fit(prepared)
    encoded = encoder.transform(prepared).select("label", "features")
    width = len(encoded.select("features").first()[0])
    network = MultilayerPerceptronClassifier(
        layers=[width, cfg.categorical_hidden, len(CLASSES)], maxIter=cfg.fit_iterations, seed=cfg.seed
    )
    tail = _fit([network], encoded)
    model = PipelineModel(stages=[*encoder.stages, *tail.stages])
    return Channel("categorical", CHANNELS["embedding"], features, model)


def _score_categorical(ch: Channel, df: DataFrame) -> DataFrame:
    prepared = df.withColumns(
        {
            "_port": name("Destination Port").cast("string"),
            "_proto": name("Protocol").cast("string"),
            "numbers": vector(feature_array(ch.features)),
        }
    )
    return _probability_score(ch, prepared).drop("_port", "_proto", "numbers")


# --- raw header bytes ---


def header_features(block: Column) -> Column:
    """Means of 16-byte strides of the scaled header block."""
    return stride_means(block, HEADER_STRIDE)


def fit_header(df: DataFrame, cfg: Settings, trees: int | None = None) -> Channel | None:
    """None when no flow has a header block with anything in it."""
    filled = df.filter(F.replace(F.hex("header_bytes"), F.lit("0"), F.lit("")) != "")
    if filled.isEmpty():
        return None
    grown = _grown(df, header_features(F.col("header_bytes")), cfg, trees or cfg.forest_trees, cfg.header_depth)
    return Channel("header", CHANNELS["hdr"], ["header_bytes"], grown)


def _score_header(ch: Channel, df: DataFrame) -> DataFrame:
    if "header_bytes" not in df.columns:
        return df.withColumn(ch.out, F.lit(0.0))
    return ch.pipeline.score(df, header_features(F.col("header_bytes")), ch.out)


# --- packet tensors ---


def packet_inputs(sequence: Column) -> Column:
    """The numbers of a flow's packets one after another, zeros behind a short sequence."""
    flat = F.flatten(sequence).cast("array<double>")
    return vector(F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(PACKETS_PER_FLOW * PACKET_FEATURES) - F.size(flat))))


def fit_packets(df: DataFrame, cfg: Settings) -> Channel | None:
    """Trained on flows with packets only; None unless both classes occur there."""
    data = _only_label(df.filter("found"), packet_inputs(F.col("sequence")))
    if data.select("label").distinct().count() < 2:
        return None
    network = MultilayerPerceptronClassifier(
        layers=[PACKETS_PER_FLOW * PACKET_FEATURES, cfg.packet_hidden, len(CLASSES)], maxIter=cfg.fit_iterations, seed=cfg.seed
    )
    # one pass: the network keeps the blocks it makes of its rows, a second copy would only push them out
    model = Pipeline(stages=[network]).fit(data)
    return Channel("packets", CHANNELS["lstm_pkt"], ["sequence"], model)


def _score_packets(ch: Channel, df: DataFrame) -> DataFrame:
    data = df.withColumn("features", packet_inputs(F.col("sequence")))
    return _probability_score(ch, data)


_SCORERS = {
    "forest": _score_forest,
    "reconstruction": _score_reconstruction,
    "sequence": _score_sequence,
    "categorical": _score_categorical,
    "header": _score_header,
    "packets": _score_packets,
}


def score_channels(flows: DataFrame, channels: list[Channel], gate: bool) -> DataFrame:
    """All channel columns on flows carrying ``l1_triggered``.

    With gating, row-wise channels run on triggered rows only and the others
    get zeros; the sequence channel needs every row for its windows and is
    masked afterwards. Channels without a model are zero.
    """
    df = flows
    for ch in channels:
        if ch.kind == "sequence":
            df = ch.score(df)
            if gate:
                df = df.withColumn(ch.out, F.when(F.col("l1_triggered"), F.col(ch.out)).otherwise(0.0))
    rowwise = [ch for ch in channels if ch.kind != "sequence"]
    live = df.filter("l1_triggered") if gate else df
    for ch in rowwise:
        live = ch.score(live)
    if gate:
        idle = df.filter(~F.col("l1_triggered"))
        live = live.unionByName(
            idle.withColumns(
                {c: F.lit(0.0) for c in live.columns if c not in idle.columns}
            )
        )
    absent = {c: F.lit(0.0) for c in CHANNELS.values() if c not in live.columns}
    return live.withColumns(absent) if absent else live
