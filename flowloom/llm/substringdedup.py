"""Substring dedup: words covered by a long string of an earlier document go.

A window is a string of ``width`` words of one document; it is repeated when a document
with a smaller doc_id holds it too. Repeated windows are found with suffix automata of
reference shards: documents stream through an automaton, which tells for every word the
longest string ending there that the shard holds (matching statistics), and spans of at
least ``width`` words go.

Which shard a document has to meet is found first, so that no document meets all shards:

1. Each window names an anchor, the leftmost of the least-hashed strings of half its width
   inside it. Equal windows name equal anchors, so only anchors of two documents matter;
   they are counted in partial aggregations. A segment is the text of a run of windows that
   name one anchor.
2. Where an anchor has one segment only, its earliest document is the reference of all
   others. Where segments differ, the reference of each window is found by a hash of the
   window. Which anchors these are travels as a table of bits of fixed size; more anchors
   than it can tell apart make more windows to look at, never fewer.
3. A reference shard is a block of words of a reference document. Its automaton is sent to
   every task with documents that refer to it: documents of a block that very many refer to
   are dealt to several tasks, each with the automaton.

A shard has a bounded size, each document meets only shards that should hold one of its
windows, and only what the automata match is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import Bits, chunks, col, partitions, slices, written
from flowloom.llm.linededup import with_rid
from flowloom.operators import skew

PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 20  # window starts that are looked at together
BLOCK = 1024  # window starts of a reference shard
SHARED = 20_000  # runs that go through one copy of an automaton
BITS = 27
LAST = (1 << 63) - 1  # where a missing doc_id stands in the order
ODD = [np.uint64(x | 1) for x in np.random.default_rng(31).integers(0, 1 << 63, 64).tolist()]


class _Numbers(dict):
    """Numbers words in the order in which they come, and notes those that are new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Words:
    """Hashes of the words of texts; remembers words, and starts anew when there are many."""

    def __init__(self, most: int = 200_000):
        self.most, self.known, self.hashes = most, _Numbers(), np.empty(1 << 12, np.uint64)

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.__init__(self.most)
        ids = np.array([*map(self.known.__getitem__, words_of(text))], np.int64)
        new = self.known.new
        if new:
            size = len(self.known)
            if size > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty(size, np.uint64)])
            self.hashes[size - len(new) : size] = [xxhash.xxh64_intdigest(w, 12) for w in new]
            new.clear()
        return self.hashes[ids]


def words_of(text: str) -> list[bytes]:
    """Words are parted by blank, tab, line feed, vertical tab, form feed and return, as bytes.split() parts them."""
    return text.encode("utf-8", "replace").split()


def gram_hashes(words: np.ndarray, width: int, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` words, from hashes of doubled lengths."""
    level = words if not key else (words ^ (words >> np.uint64(31))) * ODD[key]
    size, at, out = 1, 0, None
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            part = level[at:]
            out = part if out is None else out[: len(part)] * ODD[20 + bit] + part
            at += size
        if width >> (bit + 1):
            level = level[:-size] * ODD[bit] + level[size:]
            size *= 2
    out = (out ^ (out >> np.uint64(31))) * ODD[62]
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :])


class _Pieces:
    """Words of several documents side by side; a long document comes in pieces that overlap."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self):
        self.held, self.starts, self.rows, self.offsets, self.size = [], [], [], [], 0

    def cut(self, row: int, words: np.ndarray):
        """Adds a document; yields when enough words are held."""
        for at in range(0, len(words) - self.width + 1, PIECE):
            piece = words[at : at + PIECE + self.width - 1]
            self.held.append(piece)
            self.starts.append(self.size)
            self.rows.append(row)
            self.offsets.append(at)
            self.size += len(piece)
            if self.size >= PIECE:
                yield self
                self.clear()

    def runs(self):
        """(row, first window, windows, anchor, segment, place) of each run of windows that name one anchor."""
        words, half = np.concatenate(self.held), self.width // 2
        grams = gram_hashes(words, half)
        marked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        named = (_least(marked, self.width - half + 1) & PLACE).astype(np.int64)
        starts = np.array(self.starts, np.int64)
        owner = np.searchsorted(starts, np.arange(len(named)), side="right") - 1
        p = np.flatnonzero(np.arange(len(named)) + self.width <= np.append(starts[1:], len(words))[owner])
        a = named[p]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        n = np.diff(np.append(first, len(p)))
        lo = p[first]
        hi = lo + n - 1
        whole = lambda q: grams[q] * ODD[50] + grams[q + self.width - half]
        segment = (whole(lo) * ODD[51] + whole(hi)) * ODD[52] + n.astype(np.uint64)
        own = owner[lo]
        shift = np.array(self.offsets, np.int64)[own] - starts[own]
        return np.array(self.rows, np.int64)[own], lo + shift, n, grams[a[first]], segment, lo, words


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names)
    )


def _map_pieces(texts: DataFrame, width: int, schema: str, columns) -> DataFrame:
    """Columns that a function makes of the runs of windows of pieces: its rows by number, then arrays."""

    def rows(batches):
        words, pieces = _Words(), _Pieces(width)
        for b in batches:
            oids, rids = (b.column(k).to_numpy() for k in (0, 1))
            for start, part in chunks(b.column(2)):
                for i, t in enumerate(part, start):
                    for full in pieces.cut(i, words.of(t)):
                        yield from told(full, oids, rids)
            if pieces.size:
                yield from told(pieces, oids, rids)
            pieces.clear()

    def told(pieces, oids, rids):
        row, *rest = columns(pieces.runs())
        if len(row):
            yield _batch(schema, [oids[row], rids[row], *rest])

    return texts.mapInArrow(rows, schema)


def _segments(texts: DataFrame, width: int) -> DataFrame:
    def columns(runs):
        row, first, n, anchor, segment, _, _ = runs
        return row, first.astype(np.int32), n.astype(np.int32), anchor.view(np.int64), segment.view(np.int64)

    return _map_pieces(texts, width, "oid long, rid long, first int, n int, anchor long, segment long", columns)


def _windows(texts: DataFrame, width: int, asked) -> DataFrame:
    """Windows whose anchor is in ``asked`` (broadcast bits), under two hashes."""

    def columns(runs):
        row, first, n, anchor, _, place, words = runs
        at = np.flatnonzero(asked.value.has(anchor))
        n = n[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(place[at], n) + inside
        high, low = (gram_hashes(words, width, key)[place].view(np.int64) if len(place) else place for key in (40, 41))
        return np.repeat(row[at], n), (np.repeat(first[at], n) + inside).astype(np.int32), high, low

    return _map_pieces(texts, width, "oid long, rid long, first int, high long, low long", columns)


def _earliest() -> list:
    """The document with the smallest doc_id, and a place of it. All three keep the same row of those with equal
    doc_id, as they compare and merge alike."""
    return [
        F.min("oid").alias("_oid"), F.min_by("rid", "oid").alias("owner"), F.min_by("first", "oid").alias("ofirst"),
        F.max("oid").alias("_last"),
    ]


REFERENCES = "rid long, first int, n int, owner long, ofirst int, block int"


def _references(texts: DataFrame, width: int, size: int) -> DataFrame:
    """rid, first, n, owner, ofirst, block: runs of windows, and where an earlier document should hold them."""
    segments = written(_segments(texts, width), "segments")
    anchors = segments.groupBy("anchor").agg(
        *_earliest(), F.min("segment").alias("_low"), F.max("segment").alias("_high")
    ).filter(F.col("_oid") < F.col("_last"))
    anchors = written(anchors, "anchors")
    single = (
        segments.join(anchors.filter("_low = _high"), "anchor").filter("oid > _oid")
        .select("rid", "first", "n", "owner", "ofirst")
    )
    differ = Bits(BITS).joined(
        anchors.filter("_low <> _high").select("anchor"), lambda b: b.column(0).to_numpy().view(np.uint64)
    )
    asked = texts.sparkSession.sparkContext.broadcast(differ)
    windows = written(_windows(texts, width, asked), "windows")
    met = windows.groupBy("high", "low").agg(*_earliest()).filter(F.col("_oid") < F.col("_last"))
    opened = (
        windows.join(met, ["high", "low"]).filter("oid > _oid")
        .select("rid", "first", F.lit(1).alias("n"), "owner", "ofirst")
    )
    of_one = F.collect_list(F.struct("first", "n", "owner", "ofirst")).alias("runs")  # no more than a document has
    return single.unionByName(opened).groupBy("rid").agg(of_one).mapInArrow(
        lambda batches: _joined_runs(batches, size), REFERENCES
    )


def _joined_runs(batches, size: int):
    """Runs that go on with each other in the reference as in the document, cut at its blocks."""
    for b in (part for whole in batches for part in slices(whole, 64)):
        lists = b.column(1)
        rid = np.repeat(b.column(0).to_numpy(), pa.compute.list_value_length(lists).to_numpy())
        first, n, owner, ofirst = (f.to_numpy().astype(np.int64) for f in lists.flatten().flatten())
        # one row a window: runs of one document may overlap where it repeats itself
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rid, owner = np.repeat(rid, n), np.repeat(owner, n)
        first, ofirst = np.repeat(first, n) + inside, np.repeat(ofirst, n) + inside
        if not len(rid):
            continue
        block = ofirst // size
        order = np.lexsort((first, first - ofirst, block, owner, rid))
        rid, owner, first, ofirst, block = (x[order] for x in (rid, owner, first, ofirst, block))
        new = (rid[1:] != rid[:-1]) | (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        new |= (first[1:] - ofirst[1:] != first[:-1] - ofirst[:-1]) | (first[1:] > first[:-1] + 1)
        at = np.flatnonzero(np.concatenate([[True], new]))
        n = np.append(first[at[1:] - 1], first[-1]) - first[at] + 1
        ints = [x.astype(np.int32) for x in (first[at], n)]
        yield _batch(REFERENCES, [rid[at], *ints, owner[at], ofirst[at].astype(np.int32), block[at].astype(np.int32)])


# --- automata ---


class SuffixAutomaton:
    """All strings of words of a text, in at most two states a word."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            last = self._add(word, last)

    def _state(self, length: int, link: int, onward: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        return len(self.length) - 1

    def _add(self, word: bytes, last: int) -> int:
        onward, link, length = self.next, self.link, self.length
        new, p = self._state(length[last] + 1, 0, {}), last
        while p >= 0 and word not in onward[p]:
            onward[p][word] = new
            p = link[p]
        if p >= 0:
            q = onward[p][word]
            if length[q] != length[p] + 1:
                copy = self._state(length[p] + 1, link[q], dict(onward[q]))
                link[q] = copy
                while p >= 0 and onward[p].get(word) == q:
                    onward[p][word] = copy
                    p = link[p]
                q = copy
            link[new] = q
        return new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest string that ends with it and that the automaton holds."""
        onward, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in words:
            following = onward[state].get(word)
            while following is None and state:
                state = link[state]
                size = length[state]
                following = onward[state].get(word)
            if following is not None:
                state, size = following, size + 1
            out.append(size)
        return out


def long_matches(automaton: SuffixAutomaton, words: list[bytes], width: int) -> list[tuple[int, int]]:
    """(first word, words) of maximal spans covered by strings of at least ``width`` words in the automaton."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(automaton.matching(words), 1):
        if size >= width:
            first = end - size
            if spans and first <= sum(spans[-1]):
                first = min(first, spans[-1][0])
                spans[-1] = (first, end - first)
            else:
                spans.append((first, end - first))
    return spans


CUT = "owner long, block int, salt int, kind int, rid long, first int, part binary"
REFERENCE, RUN = 0, 1


def _parts(dealt: DataFrame, runs: DataFrame, width: int, size: int, shared: int) -> DataFrame:
    """The words of reference blocks and of the runs that refer to them, cut from the documents dealt by rid."""
    blocks = runs.groupBy("owner", "block").agg(F.ceil(F.count(F.lit(1)) / shared).cast("int").alias("salts"))
    hot = blocks.filter("salts > 1")
    salted = skew.lookup(runs, hot, ["owner", "block"]).withColumn(
        "salt", F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    mine = salted.groupBy("rid").agg(F.collect_list(F.struct("owner", "block", "salt", "first", "n")).alias("runs"))
    asked = blocks.groupBy(F.col("owner").alias("rid")).agg(F.collect_list(F.struct("block", "salts")).alias("blocks"))

    def cut(batches):
        for b in (part for whole in batches for part in slices(whole, 64)):
            out = []
            for rid, text, own, refs in zip(*(c.to_pylist() for c in b.columns)):
                if not own and not refs:
                    continue
                words = words_of(text)
                for r in own or ():
                    part = b" ".join(words[r["first"] : r["first"] + r["n"] + width - 1])
                    out.append((r["owner"], r["block"], r["salt"], RUN, rid, r["first"], part))
                for r in refs or ():
                    at = r["block"] * size
                    part = b" ".join(words[at : at + size + width - 1])
                    out += [(rid, r["block"], salt, REFERENCE, rid, at, part) for salt in range(r["salts"])]
            if out:
                yield _batch(CUT, list(zip(*out)))

    joined = dealt.join(mine, "rid", "left").join(asked, "rid", "left").select("rid", "text", "runs", "blocks")
    return joined.mapInArrow(cut, CUT)


def _matched(parts: DataFrame, width: int) -> DataFrame:
    """rid, first, n of the spans that the automata of their shards hold."""

    def rows(batches):
        shard, automaton = None, None
        for b in (part for whole in batches for part in slices(whole)):
            out = []
            for owner, block, salt, kind, rid, first, part in zip(*(c.to_pylist() for c in b.columns)):
                if kind == REFERENCE:
                    if shard != (owner, block, salt):  # rows that repeat a document have one shard
                        shard, automaton = (owner, block, salt), SuffixAutomaton(part.split())
                elif shard == (owner, block, salt):
                    out += [(rid, first + at, n) for at, n in long_matches(automaton, part.split(), width)]
            if out:
                yield _batch("rid long, first int, n int", list(zip(*out)))

    key = ["owner", "block", "salt"]
    dealt = parts.repartition(partitions(parts), *key).sortWithinPartitions(*key, "kind")
    return dealt.mapInArrow(rows, "rid long, first int, n int")


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,n:long>>, kept string"


def remove_earlier_strings(docs: DataFrame, width: int = 50, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept for every row; ``kept`` are the words that stay, joined by a blank.

    A reference shard has ``block`` window starts; ``shared`` runs go through one copy of its automaton.

    Null and empty texts have no words. Rows that repeat doc_id and text are one document
    and are treated alike; rows that share doc_id but not text neither precede nor follow
    each other. Rows without doc_id come after all others and not before one another.
    Columns beside doc_id and text are ignored. An empty table gives no rows.
    """
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    plain = docs.select(col("doc_id").alias("doc_id"), text.alias("text"))
    numbered = with_rid(plain, "rid").withColumn("oid", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    runs = written(_references(numbered.select("oid", "rid", "text"), width, block), "references")
    dealt = numbered.select("doc_id", "rid", "text").repartition(partitions(docs), "rid")
    matched = _matched(_parts(dealt, runs, width, block, shared), width)
    spans = matched.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))  # of one document

    def removed(batches):
        for b in (part for whole in batches for part in slices(whole)):
            totals, gone, kept, found = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(text)
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    change[s["first"]] += 1
                    change[s["first"] + s["n"]] -= 1
                covered = np.cumsum(change) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)))
                totals.append(len(words))
                gone.append(int(covered.sum()))
                found.append([{"first": int(f), "n": int(e - f)} for f, e in zip(edges[::2], edges[1::2])])
                if gone[-1]:
                    words = [w for w, c in zip(words, covered[:-1].tolist()) if not c]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return dealt.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(removed, KEPT)
