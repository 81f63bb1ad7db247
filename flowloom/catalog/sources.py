"""Reader and writer queries: the tables are written as files and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowloom.catalog.base import FLOWS, flows, query, table
from flowloom.functions.cleaning import micros, name
from flowloom.session import scratch_path
from flowloom.sources import flows as readers
from flowloom.sources import lines

RAW_HEADER = ("\ufeff Source IP", " Timestamp ", "Fwd Header Length", "Fwd Header Length", "Flow Packets/s", "label")


def write_raw_csv(spark, sf, path):
    """Flows in the public CSV's shape: padded names, a BOM, a repeated column."""
    f = flows(spark, sf)
    rows = f.select(
        F.concat_ws(
            ",",
            name("Source IP"),
            F.date_format("Timestamp", "dd/MM/yyyy HH:mm:ss"),
            F.col("row_id"),
            F.col("row_id") * 2,
            F.round(name("Flow Packets/s"), 2),
            F.col("Label"),
        ).alias("value"),
        "row_id",
    )
    write_with_header(rows, ",".join(RAW_HEADER), path)


def write_with_header(rows, head, path):
    """``value`` lines by row_id; every file of the folder carries the header, as separate exports do."""

    def with_header(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        for b in batches:
            yield b[["value"]]

    files = max(4, rows.rdd.getNumPartitions())
    spread = rows.repartitionByRange(files, "row_id").sortWithinPartitions("row_id")
    spread.mapInPandas(with_header, "value string").write.text(path)


RAW_SQL = f"""WITH {FLOWS} SELECT row_id, "Source IP" AS ip, epoch_us(date_trunc('second', "Timestamp")) AS micros,
  row_id::VARCHAR AS header_length, (row_id * 2)::VARCHAR AS second_header_length, round("Flow Packets/s", 2) AS pps, "Label" AS label FROM flows"""


def raw_view(df):
    return df.select(
        "row_id",
        F.col("Source IP").alias("ip"),
        micros(F.col("Timestamp")).alias("micros"),
        F.col("Fwd Header Length").alias("header_length"),
        name("Fwd Header Length.1").alias("second_header_length"),
        name("Flow Packets/s").cast("double").alias("pps"),
        F.col("Label").alias("label"),
    )


@query("flow_csv", RAW_SQL)
def flow_csv(spark, sf):
    """Public flow CSV: cleaned header, label alias, parsed times, row ids in file order."""
    path = scratch_path(spark, "flow-csv")
    write_raw_csv(spark, sf, path)
    return raw_view(readers.read_flow_csv(spark, path, strict=True))


LABELLED = {
    "a": ("number", "Label", "pps"), "b": ("Label", "port", "number", "pps"), "c": ("port", "number", "Label"),
}


@query("labelled_files", f"""WITH {FLOWS}, placed AS (SELECT *, chr(97 + (row_id % 3)::INT) AS f FROM flows)
SELECT row_number() OVER (ORDER BY f, row_id) - 1 AS row_id, row_id::VARCHAR AS number, "Label" AS label,
  CASE WHEN f <> 'a' THEN (row_id * 7)::VARCHAR END AS port, CASE WHEN f <> 'c' THEN (row_id * 3)::VARCHAR END AS pps FROM placed""")
def labelled_files(spark, sf):
    """Three sets of files with columns of their own, in orders of their own, read in one scan."""
    path = scratch_path(spark, "labelled-files")
    f = flows(spark, sf)
    for k, (folder, head) in enumerate(LABELLED.items()):
        values = {"number": F.col("row_id"), "Label": F.col("Label"), "port": F.col("row_id") * 7, "pps": F.col("row_id") * 3}
        rows = f.filter(F.col("row_id") % 3 == k).select(F.concat_ws(",", *[values[h] for h in head]).alias("value"), "row_id")
        write_with_header(rows, ",".join(head), f"{path}/{folder}")
    df = readers.read_labelled_files(spark, [f"{path}/{folder}" for folder in LABELLED])
    return df.select("row_id", "number", F.col("Label").alias("label"), "port", "pps")


@query("cached_flow_csv", RAW_SQL)
def cached_flow_csv(spark, sf):
    """The same file through its columnar copy, read twice."""
    path = scratch_path(spark, "flow-csv")
    write_raw_csv(spark, sf, path)
    readers.read_flows(spark, path, columnar_cache=True)
    return raw_view(readers.read_flows(spark, path, columnar_cache=True))


@query(
    "limited_flow_csv",
    RAW_SQL + " ORDER BY row_id LIMIT 700",
)
def limited_flow_csv(spark, sf):
    """The first rows of the file."""
    path = scratch_path(spark, "flow-csv")
    write_raw_csv(spark, sf, path)
    return raw_view(readers.read_flows(spark, path, row_limit=700))


@query(
    "corporate_csv",
    f"""WITH {FLOWS} SELECT "Source IP" AS ip, count(*) AS flows, count(*) FILTER (WHERE "Label" <> 'BENIGN') AS attacks,
  min(epoch_us(date_trunc('second', "Timestamp"))) AS first_micros FROM flows GROUP BY 1""",
)
def corporate_csv(spark, sf):
    """Corporate labelled CSV, checked on read."""
    path = scratch_path(spark, "corporate-csv")
    flows(spark, sf).select(
        F.col("row_id").alias("Flow ID"),
        "Source IP",
        "Destination IP",
        "Protocol",
        F.date_format("Timestamp", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        "Label",
        "Destination Port",
    ).write.option("header", True).csv(path)
    df = readers.read_corporate_csv(spark, path, strict_timestamp=True)
    return df.groupBy(F.col("Source IP").alias("ip")).agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("Label") != "BENIGN").alias("attacks"),
        F.min(micros(F.col("Timestamp"))).alias("first_micros"),
    )


@query(
    "prepared_round_trip",
    f"""WITH {FLOWS} SELECT "Label" AS label, 2 * count(*) AS rows, round(2 * sum("Flow Packets/s"), 2) AS pps FROM flows GROUP BY 1""",
)
def prepared_round_trip(spark, sf):
    """Prepared table overwritten once, then appended to with its own schema."""
    path = scratch_path(spark, "prepared")
    f = flows(spark, sf).select("row_id", "Timestamp", "Label", "Flow Packets/s")
    readers.write_prepared(f, path)
    readers.write_prepared(f, path, append=True)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("Flow Packets/s"), 2).alias("pps")
    )


@query("labels_csv", "SELECT doc_id::VARCHAR AS sample_id, quality::VARCHAR AS is_attack FROM labels")
def labels_csv(spark, sf):
    """Labelled samples from CSV."""
    path = scratch_path(spark, "labels-csv")
    table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("is_attack")
    ).write.option("header", True).csv(path)
    return lines.read_labels(spark, path)


@query(
    "incident_card_files",
    """SELECT c_custkey::VARCHAR AS incident_id, round(c_acctbal, 2) AS threat_score, c_mktsegment AS recommendation FROM customer""",
)
def incident_card_files(spark, sf):
    """Incident cards exported as JSON and read back."""
    from flowloom.operators.governance import incidents_from_alerts
    from flowloom.sources.sinks import write_cards

    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("alert_seq"),
        F.round("c_acctbal", 2).alias("threat_score"),
        F.col("c_mktsegment").alias("recommendation"),
    )
    incidents = incidents_from_alerts(a, dt.datetime(2024, 7, 1)).withColumn(
        "incident_id", F.col("alert_seq").cast("string")
    )
    path = scratch_path(spark, "cards")
    write_cards(incidents, path)
    return spark.read.json(path).select("incident_id", "threat_score", "recommendation")
