"""A growing text table as a stream, with micro-batches bounded by rows.

``spark.readStream.format("tail")`` follows one file that a producer appends to. An
offset is (generation, byte, row): the place behind the last whole line that was planned.
Each micro-batch takes at most ``rows`` further lines, the rest waits for the next one;
a last line without an end waits until it has one. A file that became shorter, or whose
first line changed, is a new generation and is read from its start. Offsets are kept by
the query's checkpoint, so a restarted stream goes on behind the last planned batch and
repeats a batch that was not finished.

A stream that has fallen behind catches up with ``together`` such batches in one
micro-batch; every line carries the number of its own, ``batch``, which goes on from
micro-batch to micro-batch and is kept in the offsets. Batches hold the same rows
however many of them come together.

The driver looks only at line ends of what it plans; lines are read by tasks,
each a byte range, a line belonging to the range it begins in. Paths are those of
``pyarrow.fs`` (local, hdfs, s3, gs). Rows are generation, place (byte at which the line
begins), batch and value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "generation long, place long, batch long, value string"
LOOK = 1 << 20  # bytes looked at together
SPLIT = 8 << 20  # bytes of a task
SENT = 8192  # lines of an Arrow batch, at least


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and "://" not in path:
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """Random access to a file, or None where there is none."""
    files, place = located(path)
    if files.get_file_info(place).type != fs.FileType.File:
        return None
    return files.open_input_file(place)


def first_line(file) -> bytes | None:
    """The first line with its end, or None while it is not whole."""
    file.seek(0)
    held = b""
    while part := file.read(LOOK):
        held += part
        if (end := held.find(b"\n")) >= 0:
            return held[: end + 1]
    return None


class _Range(InputPartition):
    def __init__(self, generation: int, start: int, end: int, head: bytes, header: bool, batch: int = 0, line: int = 0):
        self.generation, self.start, self.end, self.head, self.header = generation, start, end, head, header
        self.batch, self.line = batch, line  # of the first line that was planned; lines planned before this range


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rows = int(options.get("rows", "512"))
        self.header = options.get("header", "true").lower() == "true"
        self.together = int(options.get("together", "0"))  # 0: one batch, not numbered
        self.planned = self.initialOffset()
        if self.rows < 1:
            raise ValueError("rows must be 1 or more")

    def initialOffset(self) -> dict:
        return {"generation": 0, "byte": 0, "row": 0, "head": 0, **({"batch": 0} if self.together else {})}

    def latestOffset(self) -> dict:
        """At most ``rows`` lines (of each batch) behind what is planned; the same offset where nothing whole has come."""
        at = dict(self.planned)
        file = opened(self.path)
        if file is None:
            return at
        with file:
            head = first_line(file)
            if head is None:
                return at
            mark = zlib.crc32(head)
            if at["byte"] and (file.size() < at["byte"] or at["head"] != mark):
                at = {**at, "generation": at["generation"] + 1, "byte": 0, "row": 0}
            if at["byte"] == 0 and self.header:
                at["byte"] = len(head)
            at["head"] = mark
            left, before = self.rows * max(self.together, 1), at["row"]
            file.seek(at["byte"])
            looked = at["byte"]
            while left and (part := file.read(LOOK)):
                ends = part.count(b"\n")
                if ends <= left:
                    left -= ends
                    at["row"] += ends
                    if ends:
                        at["byte"] = looked + part.rfind(b"\n") + 1
                else:
                    end = -1
                    for _ in range(left):
                        end = part.find(b"\n", end + 1)
                    at["row"] += left
                    at["byte"], left = looked + end + 1, 0
                looked += len(part)
            if self.together:
                at["batch"] = at.get("batch", 0) - (before - at["row"]) // self.rows  # rounded up
        return at if at["row"] or at["generation"] != self.planned["generation"] else dict(self.planned)

    def partitions(self, start: dict, end: dict):
        """Byte ranges between two offsets; also called with equal ones after a restart, to say where the query is."""
        self.planned = dict(end)
        first = start["byte"] if start["generation"] == end["generation"] else 0
        head = b""
        if self.header and (file := opened(self.path)) is not None:
            with file:
                head = first_line(file) or b""
        if self.header and first == 0:
            first = min(len(head), end["byte"])
        cuts = list(range(first, end["byte"], SPLIT))
        lines = self._lines_before(cuts) if self.together else [0] * len(cuts)
        batch = start.get("batch", 0)
        return [
            _Range(end["generation"], a, min(a + SPLIT, end["byte"]), head, self.header, batch, n) for a, n in zip(cuts, lines)
        ]

    def _lines_before(self, cuts: list[int]) -> list[int]:
        """For each cut how many lines begin between the first cut and it."""
        file = opened(self.path)
        if not cuts or file is None:
            return [0] * len(cuts)
        out, ends = [0], 0
        with file:
            for a, b in zip(cuts, cuts[1:]):
                file.seek(max(a - 1, cuts[0]))  # a line's end right before a cut begins a line at the cut
                left = b - 1 - file.tell()
                while left and (part := file.read(min(LOOK, left))):
                    ends, left = ends + part.count(b"\n"), left - len(part)
                out.append(1 + ends)
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        file = opened(self.path)
        if file is None:
            return
        with file:
            # a line that began before this range belongs to the one before
            at, skip = max(partition.start - 1, 0), partition.start > 0
            file.seek(at)
            held, places, numbers, values, part, n = b"", [], [], [], b" ", partition.line
            while part and at < partition.end:
                part = file.read(LOOK)
                *lines, held = (held + part).split(b"\n")
                for line in lines:
                    begins, at = at, at + len(line) + 1
                    if begins >= partition.end:
                        break
                    if not skip and not (partition.header and line + b"\n" == partition.head):
                        places.append(begins)
                        numbers.append(partition.batch + n // self.rows)
                        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    n += not skip
                    skip = False
                if len(places) >= SENT:
                    yield self._batch(partition, places, numbers, values)
                    places, numbers, values = [], [], []
            if places:
                yield self._batch(partition, places, numbers, values)

    def _batch(self, partition: _Range, places: list[int], numbers: list[int], values: list[str]) -> pa.RecordBatch:
        generation = pa.array([partition.generation] * len(places), pa.int64())
        return pa.RecordBatch.from_arrays(
            [generation, pa.array(places, pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.string())],
            names=["generation", "place", "batch", "value"],
        )


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, rows: int = 512, header: bool = True, together: int = 1) -> DataFrame:
    """Stream of the lines of a growing file, ``together`` batches of ``rows`` at most in a micro-batch."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("rows", rows).option("together", together)
    return reader.option("header", str(header).lower()).load(path)


def tail_csv(
    spark: SparkSession, path: str, schema: str, rows: int = 512, options: dict[str, str] | None = None, together: int = 1
) -> DataFrame:
    """Stream of a growing CSV with a header line; ``schema`` names its columns in their order.

    Values that do not fit their column are null, as in a read of the whole file.
    """
    parsed = F.from_csv("value", schema, {"mode": "PERMISSIVE", **(options or {})}).alias("_row")
    lines = tail_lines(spark, path, rows, together=together)
    return lines.select("generation", "place", "batch", parsed).select("generation", "place", "batch", "_row.*")
