"""Streaming, incremental and retention queries.

Streams are replayed: the whole table arrives in three slices by time, the job
runs after each arrival, and the query returns what it has written.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import accumulate

from pyarrow import fs
from pyspark.sql import functions as F

from flowloom.catalog.alerts import NETWORK, RULES, _SHORT, _SUPPRESS
from flowloom.catalog.base import FLOWS_URI, flows, query, table
from flowloom.catalog.siem import PROXY_SQL, proxied, proxy_lines
from flowloom.catalog.traffic import B, HOUR, MULTIPLIER
from flowloom.functions.cleaning import micros
from flowloom.operators import retention
from flowloom.plans.detect import detect
from flowloom.session import scratch_path
from flowloom.settings import Settings
from flowloom.sources import sinks, tail
from flowloom.streaming import jobs, progress
from flowloom.streaming.suppression import suppress_stream

CUTS = ("2024-01-11", "2024-01-21")
CFG = Settings(bucket_seconds=HOUR, syn_multiplier=MULTIPLIER, alert_threshold=30.0)
DAY = 86_400
CSV = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "emptyValue": "\u2205", "nullValue": ""}


def by_time(df, column="Timestamp"):
    t = F.col(column)
    a, b = (F.lit(c).cast("timestamp") for c in CUTS)
    return [df.filter(t < a), df.filter((t >= a) & (t < b)), df.filter(t >= b)]


def folders(spark, tag):
    root = scratch_path(spark, tag)
    return f"{root}/in", f"{root}/out", f"{root}/place"


def ddl(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@query("proxy_stream", f"WITH {PROXY_SQL} SELECT * EXCLUDE (row_id) FROM proxied")
def proxy_stream(spark, sf):
    """Proxy lines arriving in files become flow rows exactly once."""
    source, out, place = folders(spark, "proxy-stream")
    lines = proxy_lines(spark, sf).join(
        table(spark, sf, "events").select(
            F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("t")
        ),
        "row_id",
    )
    slices = [s.select("value") for s in by_time(lines, "t")]
    jobs.replay(slices, source, lambda: jobs.ingest_proxy(spark, source, out, place), "text")
    flows_out = spark.read.parquet(out).withColumn("row_id", F.lit(0))
    return proxied(flows_out).drop("row_id")


@query(
    "proxy_stream_outcomes",
    """SELECT count(*) AS processed_lines, count(*) FILTER (WHERE event_id % 10 > 3) AS valid_records,
  count(*) FILTER (WHERE event_id % 10 <= 3) AS quarantined FROM events""",
)
def proxy_stream_outcomes(spark, sf):
    """Counters and quarantine kept per batch, added up."""
    source, out, place = folders(spark, "proxy-outcomes")
    lines = proxy_lines(spark, sf).select("value")
    parts = [lines.filter(F.length("value") % 2 == i) for i in (0, 1)]
    jobs.replay(parts, source, lambda: jobs.ingest_outcomes(spark, source, out, place), "text")
    quarantined = spark.read.parquet(f"{out}/quarantine").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{out}/counts").agg(
        F.sum("processed_lines").alias("processed_lines"),
        F.sum("valid_records").alias("valid_records"),
        quarantined.select("n").scalar().alias("quarantined"),
    )


@query(
    "buffer_sync_stream",
    f"""WITH {PROXY_SQL} SELECT micros, ip, port, length(uri)::DOUBLE AS token_len, length(qname)::DOUBLE AS qname_len,
  syn::DOUBLE AS syn, 0 AS is_attack FROM proxied""",
)
def buffer_sync_stream(spark, sf):
    """Proxy lines to prepared rows of the online buffer, in arrival slices."""
    source, out, place = folders(spark, "buffer-sync")
    lines = proxy_lines(spark, sf).select("value")
    parts = [lines.filter(F.length("value") % 2 == i) for i in (0, 1)]
    jobs.replay(parts, source, lambda: jobs.sync_buffer(spark, source, out, place), "text")
    return spark.read.parquet(out).select(
        micros(F.col("Timestamp")).alias("micros"),
        F.col("Source IP").alias("ip"),
        F.col("Destination Port").alias("port"),
        F.col("http_token_len").alias("token_len"),
        F.col("dns_qname_len").alias("qname_len"),
        F.col("SYN Flag Count").alias("syn"),
        "is_attack",
    )


PART = "CASE WHEN \"Timestamp\" < TIMESTAMP '2024-01-11' THEN 0 WHEN \"Timestamp\" < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"
# Detection with level-1 statistics of each part on its own.
BATCHED = f"""{FLOWS_URI}, c AS (SELECT *, {PART} AS part, {B} AS bucket FROM flows),
totals AS (SELECT part, bucket, sum("SYN Flag Count") AS s FROM c GROUP BY ALL),
spans AS (SELECT part, unnest(generate_series(min(bucket), max(bucket), 3600000000)) AS bucket FROM totals GROUP BY part),
dense AS (SELECT part, bucket, coalesce(s, 0)::DOUBLE AS s FROM spans LEFT JOIN totals USING (part, bucket)),
stats AS (SELECT part, avg(s) AS m, stddev_samp(s) AS d FROM dense GROUP BY part),
scored AS (SELECT row_id, part, "Source IP" AS ip, "Timestamp" AS ts, {RULES} AS rules,
  {", ".join(f"{col} AS {k}" for k, col in _SHORT.items())} FROM c JOIN dense USING (part, bucket) JOIN stats USING (part)
  WHERE coalesce(dense.s > m + {MULTIPLIER} * d, false)),
fused AS (SELECT *, {NETWORK} AS network FROM scored
  WHERE rf >= 0.5 OR lstm >= 0.5 OR pkt >= 0.5 OR emb >= 0.5 OR hdr >= 0.5 OR ae >= 1.5),
alerts AS (SELECT row_id AS alert_seq, part, ip, ts, round(100 * least(1.0, network + least(0.16, len(rules) * 0.035::DOUBLE)), 2) AS threat_score
  FROM fused)"""


@query(
    "detection_stream",
    f"WITH {BATCHED} SELECT alert_seq, ip, threat_score FROM alerts WHERE threat_score >= 30",
)
def detection_stream(spark, sf):
    """Micro-batch detection with level-1 statistics per batch."""
    source, out, place = folders(spark, "detection-stream")
    f = flows(spark, sf, uri=True)
    schema = ddl(f)
    jobs.replay(
        by_time(f), source, lambda: jobs.detect_stream(spark, source, schema, out, place, CFG)
    )
    return spark.read.parquet(out).select("alert_seq", "ip", "threat_score")


def _csv_lines(df, order: str):
    """CSV lines of a table in order, as a producer would append them, and the header before them."""
    header = ",".join(f'"{c}"' for c in df.columns)
    lines = df.orderBy(order).select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), CSV).alias("value"))
    return header, lines


def _copy(piece: tuple[str, str, int]) -> None:
    """One part of a text to its place in the whole file."""
    part, whole, at = piece
    files, place = tail.located(part)
    with files.open_input_stream(place) as source, open(whole, "r+b") as out:
        out.seek(at)
        while held := source.read(tail.LOOK):
            out.write(held)


def _produce(path: str, header: str, lines, cut: int = 0) -> None:
    """Write lines to the one file that a tail follows; ``cut`` bytes of the last line are still to come.

    The lines are written in sorted parts by tasks, which then put the parts side by side. Where files
    cannot be written in the middle (anything but a shared folder), the parts are appended piece by piece.
    """
    parts = f"{path}-parts"
    lines.write.mode("overwrite").text(parts)
    files, place = tail.located(path)
    folder = tail.located(parts)[1]
    found = [f for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-") and f.size]
    found.sort(key=lambda f: f.base_name)
    head = header.encode() + b"\n"
    places = list(accumulate([len(head), *(f.size for f in found)]))
    if isinstance(files, fs.LocalFileSystem):
        with open(place, "wb") as out:
            out.write(head)
            out.truncate(places[-1])
        pieces = [(f.path, place, at) for f, at in zip(found, places)]
        if pieces:
            lines.sparkSession.sparkContext.parallelize(pieces, min(len(pieces), 1000)).foreach(_copy)
        with open(place, "r+b") as out:
            out.truncate(places[-1] - cut)
    else:
        left = places[-1] - cut - len(head)
        with files.open_output_stream(place) as out:
            out.write(head[: len(head) + min(left, 0)])
            for f in found:
                with files.open_input_stream(f.path) as source:
                    while left > 0 and (held := source.read(min(tail.LOOK, left))):
                        out.write(held)
                        left -= len(held)
    files.delete_dir(folder)


@query(
    "row_bounded_stream",
    """WITH e AS (SELECT event_id AS row_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events)
SELECT (CASE WHEN k = n THEN (n - 2) // 512 + 1 ELSE (k - 1) // 512 END)::INTEGER AS batch, row_id, 0::BIGINT AS generation
FROM e""",
)
def row_bounded_stream(spark, sf):
    """One growing file in batches of 512 rows, over two runs of the stream; half a line waits for its end."""
    source, out, place = folders(spark, "row-bounded")
    source = f"{source}/flows.csv"
    f = flows(spark, sf).select("row_id", "Timestamp", "`Source IP`")
    header, lines = _csv_lines(f, "row_id")
    run = lambda: jobs.follow(jobs.tail_stream(spark, source, ddl(f), out, place, 512, CSV))
    _produce(source, header, lines, cut=3)
    run()
    _produce(source, header, lines)
    run()
    return spark.read.parquet(out).select("batch", "row_id", "generation")


@query(
    "truncated_tail_stream",
    """SELECT event_id AS row_id, generation FROM events, (SELECT unnest([0, 1, 2])::BIGINT AS generation)
WHERE generation = 0 OR (generation = 1 AND event_id % 3 = 0) OR (generation = 2 AND event_id % 2 = 1)""",
)
def truncated_tail_stream(spark, sf):
    """A followed file that becomes shorter, then gets another first line, is read again from its start."""
    source, out, place = folders(spark, "truncated-tail")
    source = f"{source}/flows.csv"
    f = flows(spark, sf).select("row_id", "`Source IP`")
    run = lambda: jobs.follow(jobs.tail_stream(spark, source, ddl(f), out, place, 4096, CSV))
    header, lines = _csv_lines(f, "row_id")
    _produce(source, header, lines)
    run()
    _produce(source, *_csv_lines(f.filter("row_id % 3 = 0"), "row_id"))
    run()
    _produce(source, header + " ", _csv_lines(f.filter("row_id % 2 = 1"), "row_id")[1])
    run()
    return spark.read.parquet(out).select("row_id", "generation")


TAIL_ROWS = 2000
TAILED = BATCHED.replace(PART, f"((row_number() OVER (ORDER BY row_id) - 1) // {TAIL_ROWS})")


@query(
    "realtime_tail_alerts",
    f"WITH {TAILED} SELECT alert_seq, ip, threat_score FROM alerts WHERE threat_score >= 30 ORDER BY alert_seq DESC LIMIT 200",
)
def realtime_tail_alerts(spark, sf):
    """The last 200 alerts of detection over a growing file, kept batch by batch."""
    source, out, place = folders(spark, "tail-alerts")
    source = f"{source}/flows.csv"
    f = flows(spark, sf, uri=True)
    _produce(source, *_csv_lines(f, "row_id"))
    jobs.follow(jobs.detect_stream(
        spark, source, ddl(f), out, place, CFG, keep_last=200, rows=TAIL_ROWS, csv_options=CSV))
    return sinks.read_last(spark, f"{out}-last").select("alert_seq", "ip", "threat_score")


@query(
    "realtime_last_alerts",
    f"WITH {BATCHED} SELECT alert_seq, ip, threat_score FROM alerts WHERE threat_score >= 30 ORDER BY alert_seq DESC LIMIT 200",
)
def realtime_last_alerts(spark, sf):
    """What the realtime sink shows after the stream: the last 200 alerts."""
    return sinks.last_alerts(detection_stream(spark, sf), 200)


@query(
    "chunked_detection",
    f"WITH {BATCHED} SELECT alert_seq, part, ip, threat_score FROM alerts WHERE threat_score >= 30",
)
def chunked_detection(spark, sf):
    """The same parts in one batch job, statistics kept apart by chunk."""
    f = flows(spark, sf, uri=True)
    a, b = (F.lit(c).cast("timestamp") for c in CUTS)
    part = F.when(F.col("Timestamp") < a, 0).when(F.col("Timestamp") < b, 1).otherwise(2)
    found = detect(f.withColumn("part", part), CFG, by=["part"])
    return found.select("alert_seq", "part", "ip", "threat_score")


@query(
    "bucket_stream",
    f"""WITH {FLOWS_URI}, b AS (SELECT {B} AS bucket, round(sum("Flow Packets/s"), 4) AS packets_per_s,
  sum("SYN Flag Count")::BIGINT AS syn, count(*) AS flows FROM flows GROUP BY 1)
SELECT * FROM b""",
)
def bucket_stream(spark, sf):
    """Hourly sums in event time, with rows that come days late."""
    source, out, place = folders(spark, "bucket-stream")
    f = flows(spark, sf).select("row_id", "Timestamp", "Flow Packets/s", "SYN Flag Count")
    schema = ddl(f)
    late = F.col("row_id") % 7 == 0
    first, second, third = by_time(f)
    parts = [first.filter(~late), second, third.unionByName(first.filter(late))]
    jobs.replay(parts, source, lambda: jobs.bucket_stream(spark, source, schema, out, place, HOUR))
    return jobs.read_buckets(spark, out).withColumn("packets_per_s", F.round("packets_per_s", 4))


@query(
    "suppression_stream",
    f"""WITH RECURSIVE a AS (SELECT event_id AS alert_seq, 'u' || user_id AS ip, event_type AS severity, epoch_us(ts) AS us FROM events),
{_SUPPRESS.format(w=DAY * 1_000_000)} SELECT alert_seq, ip, severity FROM r WHERE kept""",
)
def suppression_stream(spark, sf):
    """Suppression state carried over micro-batches."""
    source, out, place = folders(spark, "suppression-stream")
    a = table(spark, sf, "events").select(
        F.col("event_id").alias("alert_seq"),
        F.concat(F.lit("u"), F.col("user_id")).alias("ip"),
        F.col("event_type").alias("severity"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    schema = ddl(a)
    jobs.replay(
        by_time(a, "ts"),
        source,
        lambda: suppress_stream(spark, source, schema, out, place, DAY),
    )
    return spark.read.parquet(out)


@query(
    "progress_checks",
    """WITH n AS (SELECT count(*) AS c FROM events), k AS (SELECT c, c * 2 // 3 AS done FROM n)
SELECT * FROM (SELECT 'grown' AS what, done AS start, NULL AS restart FROM k
  UNION ALL SELECT 'generation', 0, 'generation changed' FROM k UNION ALL SELECT 'shrunk', 0, 'table shrank' FROM k
  UNION ALL SELECT 'head', 0, 'head row changed' FROM k UNION ALL SELECT 'boundary', 0, 'boundary row changed' FROM k
  UNION ALL SELECT 'interior', 0, 'interior rows changed' FROM k UNION ALL SELECT 'first', 0, NULL FROM k
  UNION ALL SELECT 'finished', c, NULL FROM k)""",
)
def progress_checks(spark, sf):
    """Where a run starts after growth, and each reason to start over."""
    e = table(spark, sf, "events").withColumnRenamed("event_id", "row_id")
    total = e.count()
    done = total * 2 // 3
    saved = progress.prefix_digest(e, done - 1, 1)

    def edited(at: int):
        touched = F.when(F.col("row_id") == at, -1.0).otherwise(F.col("value"))
        return e.withColumn("value", touched)

    empty = spark.createDataFrame([], progress.STATE)
    cases = {
        "grown": (e, saved, 1),
        "generation": (e, saved, 2),
        "shrunk": (e.filter(F.col("row_id") < done - 5), saved, 1),
        "head": (edited(0), saved, 1),
        "boundary": (edited(done - 1), saved, 1),
        "interior": (edited(progress.watched_ids(e, done - 1)[0]), saved, 1),
        "first": (e, empty, 1),
        "finished": (e, progress.prefix_digest(e, total - 1, 1), 1),
    }
    out = None
    for what, (df, state, generation) in cases.items():
        row = progress.start_position(df, state, generation).select(
            F.lit(what).alias("what"), "start", "restart"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "incremental_rows",
    """SELECT event_id AS row_id, event_type FROM events WHERE event_id >= (SELECT count(*) * 2 // 3 FROM events)""",
)
def incremental_rows(spark, sf):
    """Rows added since the saved position."""
    e = table(spark, sf, "events").withColumnRenamed("event_id", "row_id")
    done = e.count() * 2 // 3
    place = progress.start_position(e, progress.prefix_digest(e, done - 1, 0), 0).first()
    return progress.new_rows(e, place["start"]).select("row_id", "event_type")


@query(
    "prefix_digest",
    """WITH e AS (SELECT event_id AS row_id, sha256(concat_ws('|', event_id::VARCHAR, coalesce(user_id::VARCHAR, 'nan'),
    coalesce(event_type, 'nan'), coalesce(props, 'nan'))) AS fp FROM events),
done AS (SELECT * FROM e WHERE row_id <= (SELECT count(*) // 2 - 1 FROM e)),
ends AS (SELECT count(*) AS n, min(row_id) AS a, max(row_id) AS b FROM done),
inside AS (SELECT row_id, fp FROM done, ends WHERE row_id NOT IN (a, b) ORDER BY md5(row_id::VARCHAR), row_id LIMIT 4)
SELECT 3::BIGINT AS generation, n AS rows_done, b AS last_id, (SELECT fp FROM done WHERE row_id = a) AS head,
  (SELECT fp FROM done WHERE row_id = b) AS boundary,
  (SELECT sha256(string_agg(fp, '|' ORDER BY row_id)) FROM inside) AS interior FROM ends""",
)
def prefix_digest(spark, sf):
    """State row of the first half of the table."""
    e = buffer(spark, sf)
    return progress.prefix_digest(e, e.count() // 2 - 1, 3)


BUFFER = ("row_id", "user_id", "event_type", "props")
LINE = "strlen(concat_ws(',', event_id::VARCHAR, user_id::VARCHAR, event_type, props)) + 1"
HEADER = len(",".join(BUFFER)) + 1


def buffer(spark, sf):
    return table(spark, sf, "events").withColumnRenamed("event_id", "row_id").select(*BUFFER)


@query(
    "buffer_sizes",
    f"SELECT count(*) AS rows, (sum({LINE}) + {HEADER})::BIGINT AS total_bytes, max({LINE})::INT AS longest_row FROM events",
)
def buffer_sizes(spark, sf):
    return retention.buffer_sizes(buffer(spark, sf))


RETAINED = f"""r AS (SELECT event_id, sum({LINE}) OVER w AS upto, row_number() OVER w AS rank FROM events
  WINDOW w AS (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT event_id AS row_id, (rank <= 6000 AND upto + {HEADER} <= 65536) OR rank = 1 AS kept FROM r)"""


@query("retention_marks", f"WITH {RETAINED} SELECT row_id, kept FROM m")
def retention_marks(spark, sf):
    """The newest rows within 6,000 rows and 64 KiB; the rest goes to the archive."""
    return retention.mark_tail(buffer(spark, sf), 6000, 65536).select("row_id", "kept")


@query(
    "retention_plan",
    f"""WITH {RETAINED} SELECT count(*) AS rows, count(*) FILTER (WHERE kept) AS tail_keep,
  count(*) FILTER (WHERE NOT kept) AS archived, count(*) FILTER (WHERE NOT kept) > 0 AS needs_action, false AS goal_unreachable FROM m""",
)
def retention_plan(spark, sf):
    return retention.retention_plan(buffer(spark, sf), 6000, 65536)


@query(
    "archived_rows",
    f"""WITH {RETAINED} SELECT CASE WHEN kept THEN 'kept' ELSE 'archive' END AS place, count(*) AS rows, sum(row_id)::BIGINT AS ids FROM m GROUP BY 1""",
)
def archived_rows(spark, sf):
    """Both outputs of a retention run, read back."""
    root = scratch_path(spark, "retention")
    marked = retention.mark_tail(buffer(spark, sf), 6000, 65536)
    retention.apply_retention(marked, f"{root}/kept", f"{root}/archive")
    out = None
    for place in ("kept", "archive"):
        part = spark.read.parquet(f"{root}/{place}").groupBy(F.lit(place).alias("place")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids")
        )
        out = part if out is None else out.unionByName(part)
    return out
