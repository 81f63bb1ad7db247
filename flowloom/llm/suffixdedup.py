"""Suffix-array dedup: bytes covered by a long string that occurs elsewhere go.

A window is a string of ``length`` bytes inside a document. It is repeated when its
suffix has a neighbour in the suffix array with a common prefix of ``length``. Not all
suffixes are sorted, as most windows cannot have an equal:

1. Each window names an anchor, the leftmost of the least-hashed half-length strings
   inside it. Equal windows name equal anchors at the same place, and an anchor is
   named by one run of windows. A segment is the text of such a run.
2. Anchors meet by hash. An anchor alone has no repeated window. Segments that are
   wholly equal are repeated, all of their windows. What is left are anchors with
   different segments: the ends of passages, and what surrounds an edit.
3. For these the suffixes that start at the anchor, and the reversed texts before it,
   are sorted by deep-shallow sorting: multikey quicksort over eight bytes at a time
   down to a shallow depth, then a blind trie for each group with a long common prefix.
   A window that begins l bytes before its anchor is repeated if another anchor shares
   l bytes to the left and ``length - l`` bytes to the right, which the two orders and
   their common prefixes tell for all l at once.

Segments that a task meets twice are merged before they are sent on, so copies do not
pile up in a task. An anchor with more than ``large`` different segments (a passage
that many documents share) is taken apart into its windows, which meet by their own
hash, merged in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import chunks, col, partitions, slices
from flowloom.llm.linededup import with_rid

SHALLOW = 16  # bytes that multikey quicksort looks at
PLACE = np.uint64((1 << 24) - 1)
PIECE = 4 << 20  # window starts of one document that are looked at together
BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [np.uint64(x | 1) for x in np.random.default_rng(21).integers(0, 1 << 63, 64).tolist()]


# --- anchors and segments ---


def _gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` bytes, from hashes of doubled lengths."""
    level, width, out, at = BYTES[data], 1, None, 0
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            part = level[at:]
            out = part if out is None else out[: len(part)] * ODD[32 + bit] + part
            at += width
        if length >> (bit + 1):
            level = level[:-width] * ODD[bit] + level[width:]
            width *= 2
    out = out.copy()
    out ^= out >> np.uint64(31)
    out *= ODD[63]
    out ^= out >> np.uint64(29)
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :])


def anchors(texts: list[bytes], length: int):
    """(text, anchor, first window, windows, anchor hash, segment hash) of each run of windows."""
    half, out = length // 2, []
    joined, starts, owners, limits, size = [], [], [], [], 0

    def flush():
        nonlocal joined, starts, owners, limits, size
        if size >= length:
            out.append(_anchors_of(b"".join(joined), starts, owners, limits, length, half))
        joined, starts, owners, limits, size = [], [], [], [], 0

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            piece = t[at : at + PIECE + length - 1]
            joined.append(piece)
            starts.append(size)
            owners.append(i)
            limits.append(at)
            size += len(piece)
            if size >= 1 << 20:
                flush()
    flush()
    if not out:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*out)]


def _anchors_of(data: bytes, starts, owners, offsets, length: int, half: int):
    array = np.frombuffer(data, np.uint8)
    grams = _gram_hashes(array, half)
    marked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_min(marked, length - half + 1) & PLACE).astype(np.int64)
    starts = np.array(starts, np.int64)
    owner = np.searchsorted(starts, np.arange(len(least)), side="right") - 1
    ends = np.append(starts[1:], len(array))
    valid = np.arange(len(least)) + length <= ends[owner]
    p = np.flatnonzero(valid)
    a = least[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    lo = p[first]
    at = a[first]
    hi = lo + count - 1
    # two windows that overlap hold the segment
    whole = lambda q: grams[q] * ODD[50] + grams[q + length - half]
    segment = (whole(lo) * ODD[51] + whole(hi)) * ODD[52] + count.astype(np.uint64)
    segment ^= segment >> np.uint64(32)
    own = owner[lo]
    shift = np.array(offsets, np.int64)[own] - starts[own]
    return np.array(owners, np.int64)[own], at + shift, lo + shift, count, grams[at], segment


REPEATED, OPEN, TAKEN_APART = range(3)
ROWS = "kind int, anchor long, segment long, rid long, first int, n int, off int, multi boolean"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrays = [
        pa.array(c, kinds[t]) if t == "binary" else pa.array(np.asarray(c).astype(kinds[t].to_pandas_dtype()), kinds[t])
        for c, t in zip(columns, types)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _segments(texts: DataFrame, length: int, most: int = 1_000_000) -> DataFrame:
    """Segments of all texts, each once for a task, and the runs of windows a task knows to be repeated."""

    def merged(held):
        rid, at, first, n, anchor, segment = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((first, rid, segment, anchor))
        same = (anchor[order[1:]] == anchor[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
        again = np.zeros(len(order), bool)
        again[order[1:]] = same
        multi = np.zeros(len(order), bool)
        multi[order[:-1]] = same
        keep = np.flatnonzero(~again)
        k = np.zeros(len(keep), np.int64)
        yield _batch(
            ROWS, k + OPEN, anchor[keep].view(np.int64), segment[keep].view(np.int64), rid[keep],
            first[keep], n[keep], (at - first)[keep], multi[keep],
        )
        rid, first, n = _runs(rid[again], first[again], n[again])
        z = np.zeros(len(rid), np.int64)
        # dealt out by document and place
        yield _batch(ROWS, z + REPEATED, z, z, rid, first, n, z, z)

    def rows(batches):
        held, size = [], 0
        for b in batches:
            rids = b.column(0).to_numpy()
            for start, part in chunks(b.column(1)):
                text, at, first, n, anchor, segment = anchors([t.encode("utf-8", "replace") for t in part], length)
                held.append((rids[start + text], at, first, n, anchor, segment))
                size += len(text)
                if size >= most:
                    yield from merged(held)
                    held, size = [], 0
        if size:
            yield from merged(held)

    return texts.mapInArrow(rows, ROWS)


def _runs(rid: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Runs of windows joined where one goes on with another."""
    if not len(rid):
        return rid, first, n
    order = np.lexsort((first, rid))
    rid, first, n = rid[order], first[order], n[order]
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (first[1:] != first[:-1] + n[:-1])])
    at = np.flatnonzero(new)
    return rid[at], first[at], np.add.reduceat(n, at)


def _met(segments: DataFrame, large: int) -> DataFrame:
    """Segments by anchor: repeated ones, and open ones of anchors with different segments."""
    deal = F.when(F.col("kind") == OPEN, F.xxhash64("anchor")).otherwise(F.xxhash64("rid", "first"))
    dealt = segments.repartition(partitions(segments), deal)

    def decided(c):
        _, anchor, segment, rid, first, n, off, multi = c
        if not len(anchor):
            return
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        other = np.concatenate([[True], new[1:] | (segment[1:] != segment[:-1])])
        group, seg = np.cumsum(new) - 1, np.cumsum(other) - 1
        copies = np.bincount(seg) + np.bincount(seg, weights=multi).astype(np.int64)
        different = np.bincount(group[other])
        single = np.bincount(group, weights=(copies[seg] == 1)) > 0
        again = copies[seg] > 1
        r, f, k = _runs(rid[again], first[again], n[again])
        z = np.zeros(len(r), np.int64)
        yield _batch(ROWS, z + REPEATED, z, z, r, f, k, z, z)
        at = np.flatnonzero(other & (different[group] > 1) & single[group])
        kind = np.where(different[group[at]] > large, TAKEN_APART, OPEN)
        yield _batch(ROWS, kind, anchor[at], segment[at], rid[at], first[at], n[at], off[at], again[at])

    def rows(batches):
        held = None
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = part if held is None else [np.concatenate([p, q]) for p, q in zip(held, part)]
            done = held[0] == REPEATED
            if done.any():
                yield _batch(ROWS, *[c[done] for c in held])
                held = [c[~done] for c in held]
            if len(held[1]):
                last = int(np.searchsorted(held[1], held[1][-1]))
                yield from decided([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield from decided(held)

    return dealt.sortWithinPartitions("kind", "anchor", "segment").mapInArrow(rows, ROWS)


# --- deep-shallow sorting ---


def _words(strings: list[bytes], depth: int) -> np.ndarray:
    """Eight bytes of each string from ``depth`` on, as a number that orders like them."""
    cut = b"".join(s[depth : depth + 8].ljust(8, b"\0") for s in strings)
    return np.frombuffer(cut, ">u8").astype(np.uint64)


def multikey_quicksort(strings: list[bytes], shallow: int = SHALLOW) -> list[np.ndarray]:
    """Groups of string numbers in order, each with ``shallow`` common bytes or a single member."""
    keys = [_words(strings, d) for d in range(0, shallow, 8)]
    out, todo = [], [(np.arange(len(strings)), 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= 1 or level == len(keys):
            if len(part):
                out.append(part)
            continue
        k = keys[level][part]
        pivot = np.partition(k, len(k) // 2)[len(k) // 2]
        todo.append((part[k > pivot], level))
        todo.append((part[k == pivot], level + 1))
        todo.append((part[k < pivot], level))
    return out


class BlindTrie:
    """Patricia trie that keeps branching bytes only; a string is compared once, with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None  # a list of string numbers, or [depth, {byte: node}]

    def add(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = (number, [number])
            return
        node = self.root
        while len(node) == 3:  # inner: (depth, children, any leaf)
            depth, children, _ = node
            byte = s[depth] if depth < len(s) else -1
            child = children.get(byte)
            if child is None:
                while len(node) == 3:
                    node = node[2]
                break
            node = child
        t = self.strings[node[0]]
        common = common_prefix(s, t)
        if common == len(s) == len(t):
            node[1].append(number)
            return
        parent, node = None, self.root
        while len(node) == 3 and node[0] < common:
            byte = s[node[0]] if node[0] < len(s) else -1
            parent, node = (node, byte), node[1][byte]
        mine = (number, [number])
        byte = s[common] if common < len(s) else -1
        if len(node) == 3 and node[0] == common:
            node[1][byte] = mine
            return
        leaf = node
        while len(leaf) == 3:
            leaf = leaf[2]
        u = self.strings[leaf[0]]
        inner = (common, {byte: mine, u[common] if common < len(u) else -1: node}, leaf)
        if parent is None:
            self.root = inner
        else:
            parent[0][1][parent[1]] = inner

    def ordered(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and what each has in common with the one before it."""
        numbers, shared, todo = [], [], [(self.root, 0)]
        while todo:
            node, before = todo.pop()
            if len(node) == 2:
                whole = len(self.strings[node[0]])
                for k, number in enumerate(node[1]):
                    numbers.append(number)
                    shared.append(before if k == 0 else whole)
                continue
            depth, children, _ = node
            order = sorted(children)
            for k in range(len(order) - 1, -1, -1):
                todo.append((children[order[k]], before if k == 0 else depth))
        return numbers, shared


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # the first difference lies in [lo, hi]
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it."""
    order, shared, before = [], [], None
    for group in multikey_quicksort(strings):
        if len(group) == 1:
            numbers, common = [int(group[0])], [0]
        else:
            trie = BlindTrie(strings)
            for number in group.tolist():
                trie.add(number)
            numbers, common = trie.ordered()
        common[0] = 0 if before is None else common_prefix(strings[before], strings[numbers[0]])
        order += numbers
        shared += common
        before = numbers[-1]
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(segments: list[bytes], off: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each segment and each l: whether its window l bytes before the anchor is repeated."""
    right = [s[o : o + length] for s, o in zip(segments, off.tolist())]
    left = [s[:o][::-1] for s, o in zip(segments, off.tolist())]
    m, widest = len(segments), length - length // 2 + 1
    l = np.arange(widest)

    def groups(strings, need):
        order, shared = deep_shallow_sort(strings)
        out = np.empty((m, widest), np.int64)
        out[order] = np.cumsum(shared[:, None] < need[None], axis=0)
        return out

    key = groups(right, length - l) * (m + 1) + groups(left, np.maximum(l, 0))
    # windows named by this anchor begin off, off - 1, ... off - n + 1 bytes before it
    named = (l[None] <= off[:, None]) & (l[None] > (off - n)[:, None])
    key = np.where(named, key, -1 - np.arange(m)[:, None])
    out = np.zeros((m, widest), bool)
    order = np.argsort(key, axis=0, kind="stable")
    ranked = np.take_along_axis(key, order, axis=0)
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros((m, widest), bool)
    flag[1:] |= same
    flag[:-1] |= same
    np.put_along_axis(out, order, flag, axis=0)
    return out & named


TEXTS = "kind int, anchor long, rid long, first int, n int, off int, multi boolean, text binary"
WINDOWS = "rid long, first int, n int"


def _with_text(dealt: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """The text of open segments, fetched from the documents dealt out by rid."""
    fields = F.struct("kind", "anchor", "first", "n", "off", "multi")
    wanted = open_rows.groupBy("rid").agg(F.collect_list(fields).alias("open"))  # no more than a document has

    def cut(batches):
        for b in (part for whole in batches for part in slices(whole)):
            out = []
            for rid, text, rows in zip(*(c.to_pylist() for c in b.columns)):
                if rows:
                    data = text.encode("utf-8", "replace")
                    for r in rows:
                        part = data[r["first"] : r["first"] + r["n"] + length - 1]
                        out.append((r["kind"], r["anchor"], rid, r["first"], r["n"], r["off"], r["multi"], part))
            if out:
                yield _batch(TEXTS, *zip(*out))

    joined = dealt.join(wanted, "rid", "left").select("rid", "text", "open")
    return joined.mapInArrow(cut, TEXTS)


def _sorted_out(rows: DataFrame, length: int, most: int = 6_000) -> DataFrame:
    """Repeated windows of open segments, by deep-shallow sorting of whole anchors."""

    def decided(held):
        _, _, rid, first, n, off, multi, texts = held
        flags = repeated_windows(texts, off, n, length)
        flags[multi] = False  # known already
        at, l = np.nonzero(flags)
        r, f, k = _runs(rid[at], first[at] + off[at] - l, np.ones(len(at), np.int64))
        yield _batch(WINDOWS, r, f, k)

    def found(batches):
        held = None
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]] + [b.column(7).to_pylist()]
            if held is None:
                held = part
            else:
                held = [np.concatenate([p, q]) for p, q in zip(held[:-1], part[:-1])] + [held[-1] + part[-1]]
            while len(held[0]) > most:
                anchor = held[1]
                end = int(np.searchsorted(anchor, anchor[most]))  # not inside an anchor
                if end == 0:
                    end = int(np.searchsorted(anchor, anchor[0], side="right"))
                if end == len(anchor):
                    break
                yield from decided([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield from decided(held)

    dealt = rows.repartition(partitions(rows), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(found, WINDOWS)


APART = "high long, low long, rid long, first int, multi boolean"


def _taken_apart(rows: DataFrame, length: int, most: int = 400_000) -> DataFrame:
    """Repeated windows of segments whose anchor is too common for one task."""

    def windows(batches):
        seen: dict = {}
        for b in batches:
            for _, _, rid, first, n, _, multi, text in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(n):
                    w = xxhash.xxh3_128_digest(text[k : k + length])
                    old = seen.get(w)
                    if old is None:
                        seen[w] = [(rid, first + k)], multi
                    else:
                        old[0].append((rid, first + k))
            if len(seen) >= most:
                yield from told(seen)
                seen = {}
        yield from told(seen)

    def told(seen):
        if not seen:
            return
        words = np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2)
        rid, first = np.array([v[0][0] for v in seen.values()], np.int64).T
        multi = np.array([m or len(v) > 1 for v, m in seen.values()])
        yield _batch(APART, words[:, 0], words[:, 1], rid, first, multi)
        rest = np.array([x for v, _ in seen.values() for x in v[1:]], np.int64).reshape(-1, 2)
        z = np.arange(len(rest))
        # known to be repeated: a word of its own for each
        yield _batch(APART, rest[:, 0], -1 - rest[:, 1], rest[:, 0], rest[:, 1], z >= 0)

    def met(batches):
        held = None
        for b in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = part if held is None else [np.concatenate([p, q]) for p, q in zip(held, part)]
            if len(held[0]):
                last = np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0]
                yield from again([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield from again(held)

    def again(c):
        high, low, rid, first, multi = c
        if not len(high):
            return
        group = np.cumsum(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) - 1
        many = np.bincount(group) + np.bincount(group, weights=multi).astype(np.int64) > 1
        at = many[group]
        yield _batch(WINDOWS, *_runs(rid[at], first[at], np.ones(int(at.sum()), np.int64)))

    apart = rows.mapInArrow(windows, APART)
    dealt = apart.repartition(partitions(rows), "high", "low").sortWithinPartitions("high", "low")
    return dealt.mapInArrow(met, WINDOWS)


# --- removal ---

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = 200, large: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row.

    Null texts count as empty and come back as empty. Texts shorter than ``length``
    stay whole. Rows that repeat doc_id and text count as documents of their own,
    so each removes the other.
    """
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    numbered = with_rid(docs, "_rid") if "_rid" not in docs.columns else with_rid(docs.drop("_rid"), "_rid")
    texts = numbered.select(F.col("_rid").alias("rid"), col("doc_id").alias("doc_id"), text.alias("text"))
    met = _met(_segments(texts.select("rid", "text"), length), large)
    dealt = texts.repartition(partitions(docs), "rid")
    fetched = _with_text(dealt.select("rid", "text"), met.filter(F.col("kind") != REPEATED), length)
    repeated = (
        met.filter(F.col("kind") == REPEATED).select("rid", "first", "n")
        .unionByName(_sorted_out(fetched.filter(F.col("kind") == OPEN), length))
        .unionByName(_taken_apart(fetched.filter(F.col("kind") == TAKEN_APART), length))
    )
    runs = repeated.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("runs"))  # of one document

    def removed(batches):
        for b in (part for whole in batches for part in slices(whole)):
            doc_ids, data = b.column(0), [t.encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            counts, spans, kept = [], [], []
            for d, r in zip(data, b.column(2)):
                if not r.is_valid:
                    counts.append(0)
                    spans.append(0)
                    kept.append(d)
                    continue
                first = r.values.field("first").to_numpy().astype(np.int64)
                n = r.values.field("n").to_numpy()
                change = np.zeros(len(d) + 1, np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, first + n + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                counts.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(d, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *(pa.array(x, pa.int64()) for x in ([len(d) for d in data], counts, spans)), pa.array(kept, pa.binary())],
                names=[f.split()[0] for f in KEPT.split(", ")],
            )

    joined = dealt.join(runs, "rid", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(removed, KEPT)
