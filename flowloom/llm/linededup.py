"""Line dedup: an exact set-similarity join of lines.

A line is the set of its lower-cased words. Lines come in the order of (doc_id, line
number); a line goes when an earlier one matches it with a Jaccard similarity of at
least ``least``. Lines without words never match and stay.

* The tokens of a line are ordered by rarity, counted over all lines in a table of
  fixed size (hash buckets, so a count is never too low). Two matching lines share a
  token in their prefixes; a prefix token whose bucket holds a single occurrence is
  shared with nobody and is not indexed. Equal lines of a batch are one record.
* Records that share a prefix token meet in one group. Equal sets go at once, all but
  the first. Of the others, length, position and a parity map of the tokens (its
  differing bits never outnumber the differing tokens) tell which lines have a
  candidate there. A line is named once for each of its groups, not once for each pair.
* The token sets of the named lines are fetched and sent to their groups, where Jaccard
  similarity is verified; a line is done with at its first match.

A token too frequent for one group is joined by the next common one: two lines whose
first common token it is share a second within one more place, so both are found under
that pair of tokens. Long lines would have too many pairs; they, and the groups that are
still too large, are set aside, counted exactly and cut into blocks; pairs of blocks are
compared in tasks of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from flowloom.llm.common import by_place, chunks, col, fresh, map_whole_rows, partitions, slices, written
from flowloom.session import materialize

BUCKETS, BLOCK = 1 << 22, 1 << 16  # places of the table of counts, and of the parts it is sent in
HASHED = 1 << 62  # numbers of documents without a doc_id of their own start here


@dataclass(frozen=True)
class LineDedup:
    """``large`` rows or ``heavy`` tokens make a group too large, ``short`` tokens are the most that pairs are made of."""

    least: float = 0.8
    large: int = 20_000
    short: int = 96
    heavy: int = 4_000_000

    def overlap(self, a, b):
        """Common tokens that sets of these sizes need."""
        return np.ceil(self.least / (1 + self.least) * (a + b) - 1e-9)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Tokens:
    """Numbers and hashes of the words a task has met; starts anew when large."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.known = _Numbers()
        self.hashes = np.empty(0, np.uint64)

    def lines(self, texts: list[str]):
        """Number of each word, words of each line, lines of each text."""
        if len(self.known) > self.most:
            self.known, self.hashes = _Numbers(), np.empty(0, np.uint64)
        number, numbers, sizes, counts = self.known.__getitem__, [], [], []
        for t in texts:
            lines = t.lower().split("\n")
            counts.append(len(lines))
            for line in lines:
                words = line.split()
                sizes.append(len(words))
                numbers.extend(map(number, words))
        added = list(islice(self.known, len(self.hashes), None))
        if added:
            new = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 7) for w in added], np.uint64)
            self.hashes = np.concatenate([self.hashes, new])
        return np.array(numbers, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)


def with_rid(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each document that orders like doc_id.

    Rows with the same doc_id and text are one document. Rows without doc_id, and
    those that share theirs with another text, are numbered by a hash, after all others.
    """
    text = F.xxhash64(F.coalesce(col("text").cast("string"), F.lit("")))
    shared = materialize(
        docs.groupBy(col("doc_id").alias("_i"))
        .agg(F.min(text).alias("_low"), F.max(text).alias("_high"))
        .filter((F.col("_low") != F.col("_high")) & F.col("_i").isNotNull())
        .select(F.col("_i").alias(fresh(docs, "_shared")))
    )
    mark = shared.columns[0]
    own = col("doc_id").cast("long")
    hashed = F.xxhash64(own, text).bitwiseAND(F.lit(HASHED - 1)) + F.lit(HASHED)
    if shared.isEmpty():
        return docs.withColumn(name, F.coalesce(own, hashed))
    marked = docs.join(shared, own == col(mark), "left")
    return marked.withColumn(name, F.when(own.isNull() | col(mark).isNotNull(), hashed).otherwise(own)).drop(mark)


def rarity(texts: DataFrame) -> np.ndarray:
    """Occurrences of the tokens of each hash bucket over all lines; fixed size.

    A task sends its counts as compressed blocks of the table; blocks are added up
    one after another.
    """
    blocks = BUCKETS // BLOCK

    def counted(batches):
        tokens, total = _Tokens(), np.zeros(BUCKETS, np.int32)
        for b in batches:
            for _, held in chunks(b.column(0), 8 << 20):
                numbers, *_ = tokens.lines(held)
                met, n = np.unique(numbers, return_counts=True)
                np.add.at(total, (tokens.hashes[met] % BUCKETS).astype(np.int64), n.astype(np.int32))
        yield from told(total)

    def told(total):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, total[k * BLOCK : (k + 1) * BLOCK]) for k in range(blocks)]
        parts = [(k, squeeze(x.tobytes())) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "n"]
        )

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(data), np.int32).astype(np.int64)
                sums[k] = np.minimum(sums.get(k, 0) + part, (1 << 31) - 1)
        total = [(k, x.astype(np.int32).tobytes()) for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.int32()), pa.array([x for _, x in total], pa.binary())], names=["block", "n"]
        )

    schema = "block int, n binary"
    got = texts.mapInArrow(counted, schema).repartition(blocks, "block").mapInArrow(added, schema).toArrow()
    out = np.zeros(BUCKETS, np.int32)  # all that comes to the driver, whatever the input
    for k, data in zip(got.column("block").to_pylist(), got.column("n").to_pylist()):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(data, np.int32)
    return out


class _Records:
    """Token sets of the lines of some texts, each in order of rarity."""

    def __init__(self, tokens: _Tokens, texts: list[str], counts: np.ndarray):
        numbers, sizes, self.line_counts = tokens.lines(texts)
        hashes = tokens.hashes
        n = counts[(hashes % BUCKETS).astype(np.int64)]
        order = np.lexsort((hashes, n))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        line = np.repeat(np.arange(len(sizes)), sizes)
        both = np.sort((line << 32) | rank[numbers]) if len(numbers) else np.empty(0, np.int64)
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        token = order[both & 0xFFFFFFFF]
        self.hash, self.count, self.line = hashes[token], n[token], both >> 32
        self.size = np.bincount(self.line, minlength=len(sizes))
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.full = np.flatnonzero(self.size)
        self.text_of = np.repeat(np.arange(len(texts)), self.line_counts)
        self.line_no = np.arange(len(sizes)) - np.repeat(
            np.concatenate([[0], np.cumsum(self.line_counts)[:-1]]), self.line_counts
        )

    def sums(self) -> np.ndarray:
        """64 bits that stand for each line's set."""
        x = self.hash * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.add.reduceat(x, self.start[self.full])

    def parity(self) -> np.ndarray:
        """A bit for each residue of the tokens: whether their number is odd."""
        one = np.uint64(1) << ((self.hash >> np.uint64(40)) & np.uint64(63))
        return np.bitwise_xor.reduceat(one, self.start[self.full])


ROWS = "kind int, token long, rid long, line int, size int, place int, map long, set long"
COMPARE, SET_ASIDE, COPY, MET, ASKS = range(5)


def prefix_index(places: DataFrame, counts, rule: LineDedup) -> DataFrame:
    """Prefix tokens of the lines, and the lines that an equal one of their batch precedes."""
    least = rule.least

    def rows(batches):
        tokens = _Tokens()
        for b in batches:
            rids = b.column(0).to_numpy()
            for at, held in chunks(b.column(1)):
                r = _Records(tokens, held, counts.value)
                if not len(r.full):
                    continue
                rid = rids[at : at + len(held)][r.text_of[r.full]]
                line, sums, parity = r.line_no[r.full], r.sums(), r.parity()
                order = np.lexsort((line, rid, sums))
                # a copy of the first equal record, if that is another line: repeated rows are one document
                new = np.concatenate([[True], sums[order[1:]] != sums[order[:-1]]])
                head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                again = np.zeros(len(order), bool)
                again[order] = (rid[order] != rid[head]) | (line[order] != line[head])
                record = np.full(len(r.size), -1)
                record[r.full] = np.arange(len(r.full))
                # a set of n tokens has ceil(least * n) in common with any match
                prefix = r.size - np.ceil(least * r.size - 1e-9).astype(np.int64) + 1
                place = np.arange(len(r.line)) - r.start[r.line]
                pick = np.flatnonzero((place < prefix[r.line]) & (r.count > 1) & ~again[record[r.line]])
                copies = np.flatnonzero(again)
                kind, key, pick, earlier = _keys(r, pick, prefix, counts.value, rule)
                mine = record[r.line[pick]]
                none, zeros = np.zeros(len(copies), np.int64), np.zeros(len(copies), np.int32)
                yield _batch(
                    ROWS,
                    np.append(kind, zeros + COPY),
                    # rows that only pass through are dealt out by their line
                    np.append(key & LOW32, sums[copies] & LOW32).view(np.int64),
                    np.append(rid[mine], rid[copies]),
                    np.append(line[mine], line[copies]),
                    np.append(r.size[r.line[pick]], none),
                    # tokens before the last of the key that are not of the key
                    np.append(place[pick] - earlier, none),
                    np.append(parity.view(np.int64)[mine], none),
                    np.append((sums >> np.uint64(16)).view(np.int64)[mine], none),
                )

    return places.mapInArrow(rows, ROWS)


LOW32 = np.uint64((1 << 32) - 1)  # groups that two tokens share only have more candidates


def _keys(r: _Records, pick: np.ndarray, prefix: np.ndarray, counts: np.ndarray, rule: LineDedup):
    """Kind, key, place in the records and earlier tokens of the key, of the prefix tokens ``pick``.

    A rare token is a key. A frequent one makes pairs with the tokens up to one place
    beyond the prefix. Lines of more than ``least * short`` tokens (also) have it alone,
    set aside, and lines that match with a single common token have it alone.
    """
    size, hashes, line = r.size[r.line[pick]], r.hash, r.line[pick]
    often = r.count[pick] > rule.large
    single = often & (np.ceil(rule.least * size - 1e-9) <= 1)
    long = often & (size > rule.least * rule.short) & ~single
    paired = pick[often & (size <= rule.short)]
    first = paired + 1
    end = r.start[r.line[paired]] + np.minimum(prefix[r.line[paired]] + 1, r.size[r.line[paired]])
    n = np.maximum(end - first, 0)
    one = np.repeat(paired, n)
    two = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = (hashes[one] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[two] * np.uint64(0xC2B2AE3D27D4EB4F))
    pair ^= pair >> np.uint64(31)
    # rows that such a pair would have if its tokens were independent, and no fewer
    rows = r.count[one].astype(float) * r.count[two] / max(1, int(counts.max()))
    alone = np.concatenate([pick[~often], pick[single], pick[long]])
    kind = np.full(len(alone) + len(pair), COMPARE)
    kind[len(alone) - int(long.sum()) : len(alone)] = SET_ASIDE
    kind[len(alone) :][rows > rule.large] = SET_ASIDE
    key = np.concatenate([hashes[alone], pair])
    earlier = np.append(np.zeros(len(alone), np.int64), np.ones(len(pair), np.int64))
    return kind, key, np.append(alone, two), earlier


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(kinds[t].to_pandas_dtype()), kinds[t]) for c, t in zip(columns, types)], names=list(names)
    )


def _grouped(rows: DataFrame, keys: list[str], rule: LineDedup) -> DataFrame:
    """Groups of equal ``keys`` compared; rows of other kinds pass through.

    A group that turns out too large for a task passes through as well, set aside.
    """
    # what passes through has no group and is dealt out by its line
    dealt_by = F.when(F.col("kind") == COMPARE, F.xxhash64(*keys)).otherwise(F.xxhash64("rid", "line", "token"))
    dealt = rows.repartition(partitions(rows), dealt_by).sortWithinPartitions("kind", *keys)

    most = rule.large if len(keys) == 1 else None  # groups in blocks are no larger than two of them

    def compared(batches):
        held, aside = None, None
        for b in batches:
            part = [np.asarray(c) for c in b.columns]
            if part[0][0] != COMPARE and held is None:
                yield _passed(part)
                continue
            if aside is not None:
                same = (part[0] == COMPARE) & (part[1] == aside)
                if same.any():
                    yield _set_aside([c[same] for c in part])
                    part = [c[~same] for c in part]
                if not len(part[0]):
                    continue
                aside = None
            held = part if held is None else [np.concatenate([p, q]) for p, q in zip(held, part)]
            last = int(np.flatnonzero(_borders(held))[-1])
            if last:
                yield from _compare([h[:last] for h in held], rule)
                held = [h[last:] for h in held]
            if most is not None and held[0][0] == COMPARE and len(held[0]) > most:
                aside = held[1][0]
                yield _set_aside(held)
                held = None
        if held is not None:
            yield from _compare(held, rule)

    return dealt.mapInArrow(compared, ROWS)


def _passed(cols: list[np.ndarray]) -> pa.RecordBatch:
    return _batch(ROWS, *cols[:8])


def _set_aside(cols: list[np.ndarray]) -> pa.RecordBatch:
    return _passed([np.full(len(cols[0]), SET_ASIDE), *cols[1:]])


def _borders(cols: list[np.ndarray]) -> np.ndarray:
    keys = [cols[0], cols[1], *cols[8:10]]
    change = np.zeros(len(cols[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[True], change])


def _compare(cols: list[np.ndarray], rule: LineDedup):
    """Copies of whole groups, and the lines that have a candidate in their group.

    A line with an earlier candidate asks; one that is only a candidate of others is met.
    """
    if len(cols[0]) and (cols[0] != COMPARE).any():
        other = cols[0] != COMPARE
        yield _passed([c[other] for c in cols])
        cols = [c[~other] for c in cols]
    if len(cols[0]) < 2:
        return
    group = np.cumsum(_borders(cols))
    # equal sets first, each in the order of its lines: all but the first are copies
    order = np.lexsort((cols[3], cols[2], cols[4], cols[6], cols[7], group))
    cols, group = [c[order] for c in cols], group[order]
    same = group[1:] == group[:-1]
    for c in (cols[4], cols[6], cols[7]):  # size, parity map and sum: 120 bits and the token
        same = same & (c[1:] == c[:-1])
    copy = np.concatenate([[False], same])
    # equal sets have equal places: the group of the first token tells of them
    gone = np.flatnonzero(copy & (cols[5] == 0) & ((cols[2] != np.roll(cols[2], 1)) | (cols[3] != np.roll(cols[3], 1))))
    if len(gone):
        yield _passed([np.full(len(gone), COPY), *[c[gone] for c in cols[1:8]]])
    cols, group = [c[~copy] for c in cols], group[~copy]
    order = np.lexsort((cols[3], cols[2], group))
    cols, group = [c[order] for c in cols], group[order]
    _, token, rid, line, size, place, parity, sets = cols[:8]
    own = cols[10] if len(cols) > 10 else None
    cross = cols[8] != cols[9] if own is not None else None
    n = len(token)
    parity = parity.view(np.uint64)
    since = np.arange(n) - np.searchsorted(group, group)  # earlier members of the group
    asks, met = np.zeros(n, bool), np.zeros(n, bool)
    active, lag = np.flatnonzero(since > 0), 0
    while len(active):
        lag += 1
        active = active[since[active] >= lag]
        i, j = active, active - lag
        unknown = ~(asks[i] & met[j])  # nothing new can come of the others
        i, j = i[unknown], j[unknown]
        s, t = size[i], size[j]
        need = rule.overlap(s, t)
        # the token is the first that they share, or else they have met in its group
        near = np.minimum(s - place[i], t - place[j]) >= need
        near &= np.minimum(s, t) >= rule.least * np.maximum(s, t) - 1e-9
        if own is not None:
            near &= ~cross[i] | (own[i] != own[j])
        near[near] = np.bitwise_count(parity[i[near]] ^ parity[j[near]]) <= (s + t - 2 * need)[near]
        asks[i[near]] = True
        met[j[near]] = True
    named = asks | met
    if named.any():
        yield _passed([np.where(asks, ASKS, MET)[named], *[c[named] for c in cols[1:8]]])


def _in_blocks(rows: DataFrame, rule: LineDedup) -> DataFrame:
    """Rows set aside, compared in blocks of their groups."""
    blocks = (
        rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / rule.large).cast("int").alias("blocks"))
    )
    split = (
        rows.withColumn("kind", F.lit(COMPARE))
        .join(blocks, "token")
        .withColumn("own", F.pmod(F.xxhash64("rid", "line"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
    )
    return _grouped(split.select(*_names(ROWS), "x", "y", "own"), ["token", "x", "y"], rule)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text as compressed bytes, for rows that are dealt out whole."""
    at = docs.columns.index(text)

    def rows(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in (part for whole in batches for part in slices(whole)):
            small = [None if t is None else squeeze(t.encode("utf-8", "replace")) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(small, pa.binary())
            yield by_place(columns)

    kinds = [T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in docs.schema]
    return map_whole_rows(docs, rows, kinds)


def _unpack(data: bytes) -> str:
    return zstandard.decompress(data).decode()


MEMBERS = "token long, x int, y int, own int, rid long, line int, asks boolean, words binary"
TOKENS_SENT = 1 << 19  # tokens of sets that are sent on together


def _members(named: DataFrame, copies: DataFrame, rule: LineDedup) -> DataFrame:
    """Lines that have a candidate, once for each group (and pair of blocks of a large one)."""
    rows = (
        named.groupBy("token", "rid", "line").agg(F.max("kind").alias("kind"), F.max("size").alias("size"))
        .join(copies, ["rid", "line"], "left_anti")  # what a copy matches, its first one matches
    )
    groups = rows.groupBy("token").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / rule.large), F.ceil(F.sum("size") / rule.heavy)).cast("int").alias("blocks"),
        F.max(F.col("kind") == ASKS).alias("asked"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        rows.join(groups.filter(F.col("asked") & (F.col("n") > 1)).select("token", "blocks"), "token")
        .withColumn("own", F.pmod(F.xxhash64("rid", "line"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "rid", "line", "token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own",
            (F.col("kind") == ASKS).alias("asks"),
        )
    )


def _verified(places: DataFrame, members: DataFrame, rule: LineDedup) -> DataFrame:
    """(rid, line) of the lines of ``members`` that match an earlier line of one of their groups."""
    group = F.struct("line", "token", "x", "y", "own", "asks")
    wanted = members.groupBy("rid").agg(F.collect_list(group).alias("groups"))  # no more than its prefix tokens
    few = members.limit(FEW + 1).count() <= FEW
    texts = places.select("rid", "text")
    if few:  # so little that it goes to the texts, and not they to it
        texts = texts.join(F.broadcast(wanted.select("rid")), "rid", "left_semi")

    def fetched(batches):
        known: dict[str, int] = {}
        rows, n = [], 0
        for b in (part for whole in batches for part in slices(whole, 16)):
            for rid, data, groups in zip(*(c.to_pylist() for c in b.columns)):
                split, sets = _unpack(data).lower().split("\n"), {}
                if len(known) > 150_000:
                    known.clear()
                for g in groups:
                    k = g["line"]
                    if k not in sets:
                        words = set(split[k].split())
                        for w in words:
                            if w not in known:
                                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 7)
                        sets[k] = np.sort(np.array([known[w] for w in words], np.uint64)).tobytes()
                    rows.append((g["token"], g["x"], g["y"], g["own"], rid, k, g["asks"], sets[k]))
                    n += len(sets[k]) // 8
                    if n >= TOKENS_SENT:
                        yield _told(rows)
                        rows, n = [], 0
        if rows:
            yield _told(rows)

    sent = (
        packed(texts).join(F.broadcast(wanted) if few else wanted, "rid")
        .select("rid", "text", "groups")
        .mapInArrow(fetched, MEMBERS)
    )
    keys = ["token", "x", "y"]
    met = sent.repartition(partitions(sent), *keys).sortWithinPartitions(*keys, "rid", "line")

    def verified(batches):
        key, held = None, []
        for b in batches:
            out: list = []
            for row in zip(*(b.column(i).to_pylist() for i in range(8))):
                if row[:3] != key:
                    out += _matches(held, rule)
                    key, held = row[:3], []
                if not held or held[-1][4:6] != row[4:6]:  # rows that repeat a document are one
                    held.append(row)
            yield _lines(out)
        yield _lines(_matches(held, rule))

    return met.mapInArrow(verified, "rid long, line int").distinct()


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_names(MEMBERS))


def _lines(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int32())], names=["rid", "line"]
    )


WIDTH, EXPANDED = 512, 1 << 21  # earlier lines, and common tokens with them, that are counted together


def _matches(rows: list[tuple], rule: LineDedup) -> list[tuple]:
    """(rid, line) of the asking rows of a group, in the order of lines, that match one before them.

    Overlaps are counted from the tokens up, for some earlier lines at a time; lines
    that match take no further part.
    """
    asks = np.array([r[6] for r in rows], bool)
    if len(rows) < 2 or not asks[1:].any():
        return []
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    n_tokens = int(token.max()) + 1
    owner = np.repeat(np.arange(len(rows)), size)
    block = np.array([r[3] for r in rows])
    crossed = rows[0][1] != rows[0][2]
    found = np.zeros(len(rows), bool)
    c0 = 0
    while c0 < len(rows) - 1:
        c1 = min(c0 + WIDTH, len(rows), max(c0 + 1, int(np.searchsorted(start, start[c0] + EXPANDED // 8))))
        part = slice(start[c0], start[c1])
        by_token = np.argsort(token[part], kind="stable")
        column = owner[part][by_token] - c0
        first = np.concatenate([[0], np.cumsum(np.bincount(token[part], minlength=n_tokens))])
        hits = np.diff(first)[token]
        active = np.flatnonzero(asks & ~found & (np.arange(len(rows)) > c0))
        of_row = np.add.reduceat(hits, start[:-1])[active]  # sets are not empty
        width = c1 - c0
        share = np.maximum(np.cumsum(of_row + width) // EXPANDED, 0)
        for at in np.split(active, np.flatnonzero(np.diff(share)) + 1) if len(active) else []:
            mine = np.concatenate([np.arange(start[i], start[i + 1]) for i in at])
            n = hits[mine]
            row = np.repeat(np.repeat(np.arange(len(at)), size[at]), n)
            place = np.repeat(first[token[mine]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(row * width + column[place], minlength=len(at) * width).reshape(len(at), width)
            s, t = size[at][:, None], size[c0:c1][None, :]
            match = (common >= rule.least * (s + t - common) - 1e-9) & (np.arange(c0, c1)[None, :] < at[:, None])
            if crossed:  # lines of one block meet in a task of their own
                match &= block[at][:, None] != block[c0:c1][None, :]
            found[at[match.any(1)]] = True
        c0 = c1
    return [rows[i][4:6] for i in np.flatnonzero(found)]


FEW = 20_000  # lines in groups, of 40 bytes each, that are broadcast


def later_matches(places: DataFrame, rule: LineDedup = LineDedup()) -> DataFrame:
    """(rid, lines): the line numbers, from 0, that go from each document of (rid, text)."""
    spark = places.sparkSession
    counts = spark.sparkContext.broadcast(rarity(places.select("text")))  # fixed size
    index = prefix_index(places, counts, rule)
    found = written(_grouped(index, ["token"], rule), "line-candidates")
    aside = found.filter(F.col("kind") == SET_ASIDE)
    if not aside.isEmpty():
        found = found.unionByName(written(_in_blocks(aside, rule), "line-candidates"))
    copies = materialize(found.filter(F.col("kind") == COPY).select("rid", "line").distinct())
    members = materialize(_members(found.filter(F.col("kind").isin(MET, ASKS)), copies, rule))
    matched = materialize(_verified(places, members, rule))
    gone = copies.unionByName(matched).distinct()
    return gone.groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def dedup_lines(
    docs: DataFrame, rule: LineDedup = LineDedup(), n_lines: str | None = None, removed: str | None = None
) -> DataFrame:
    """Rows of ``docs`` with later matches removed from ``text``, all columns kept.

    ``n_lines`` and ``removed`` name columns for the number of lines and for the
    removed line numbers. A null text has no lines and stays null; an empty text is
    one line without words. Rows that repeat doc_id and text are one document: the
    same lines go from each. Rows without a doc_id of their own come last, in the
    order of a hash.
    """
    rid, gone_lines = fresh(docs, "_rid"), fresh(docs, "_gone")
    numbered = with_rid(docs, rid)
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    gone = materialize(later_matches(numbered.select(col(rid).alias("rid"), text.alias("text")), rule))
    # one row for each document: the join cannot be skewed
    joined = packed(numbered.withColumn("text", col("text").cast("string"))).join(gone.toDF(rid, gone_lines), rid, "left")
    joined = joined.select(*[col(c) for c in docs.columns], col(gone_lines))
    at, last = docs.columns.index("text"), len(docs.columns)
    counted, named = n_lines is not None, removed is not None
    kinds = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    kinds += [T.StructField(n_lines, T.IntegerType())] if counted else []
    kinds += [T.StructField(removed, T.ArrayType(T.IntegerType()))] if named else []

    def cleaned(batches):
        for b in (part for whole in batches for part in slices(whole)):
            texts, sizes, went = [], [], []
            for data, lines in zip(b.column(at).to_pylist(), b.column(last).to_pylist()):
                split = [] if data is None else _unpack(data).split("\n")
                drop = set(lines or ())
                texts.append(None if data is None else "\n".join(x for i, x in enumerate(split) if i not in drop))
                sizes.append(len(split))
                went.append(sorted(drop))
            columns = list(b.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(sizes, pa.int32())] * counted + [pa.array(went, pa.list_(pa.int32()))] * named
            yield by_place(columns)

    return map_whole_rows(joined, cleaned, kinds)
