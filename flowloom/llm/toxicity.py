"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows: one for the word, some for its first
and last letters, so that unseen forms of a known stem are understood. Filters of
several widths slide over the whole text, each keeps its largest response (max
pooling), and a logistic layer reads those. Scoring is one narrow stage over all rows.

The fit sees every labelled row outside the held-out quarter. The rows are dealt
into shards of about ``shard_rows``, so a task's work stays bounded. In each round
every shard trains on from the common model in a task of its own, and what it changed
is averaged: a row of the embedding over the shards that met it, all else by their
rows. Only the model, of fixed size, comes to the driver. Scores are calibrated to the
share of toxic labels, thresholds to each language, by sums over all calibration rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import Bits, chunks, col, fresh, partitions, slices
from flowloom.session import materialize

WORD = re.compile(r"\w+")
PAD = 0  # its embedding stays zero
HEADS, TAIL = (4, 5, 6), 4  # letters at a word's start and end that have rows of their own
PARTS = 2 + len(HEADS)


@dataclass(frozen=True)
class ToxicityConfig:
    """``shard_rows`` labelled rows, about, are trained on in one task; ``epochs`` are spread over ``rounds``."""

    shard_rows: int = 8000
    rounds: int = 4
    buckets: int = 1 << 18
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.02
    cut: float = 0.3
    least_toxic: int = 15  # toxic calibration rows a language needs for a threshold of its own
    seed: int = 42


class _Vocabulary(dict):
    """Words met so far, numbered from 1; number 0 is padding."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number

    def numbers(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def word_parts(words: list[str], buckets: int) -> np.ndarray:
    """Embedding rows of each word; a part that the word is too short for is padding."""

    def row(kind: bytes, part: str) -> int:
        return zlib.crc32(kind + part.encode("utf-8", "replace")) % (buckets - 1) + 1

    out = np.zeros((len(words), PARTS), np.int32)
    for i, w in enumerate(words):
        out[i, 0] = row(b"=", w)
        for k, n in enumerate(HEADS):
            if len(w) > n:
                out[i, 1 + k] = row(b"<", w[:n])
        if len(w) > TAIL:
            out[i, -1] = row(b">", w[-TAIL:])
    return out


class _Embedded:
    """A task's vocabulary with the summed embedding of each of its words.

    Starts anew when it has grown beyond ``most`` words.
    """

    def __init__(self, embedding: np.ndarray, most: int = 200_000):
        self.embedding, self.most = embedding, most
        self.clear()

    def clear(self) -> None:
        self.words, self.fresh_from = _Vocabulary(), 0
        self.vectors = np.zeros((1, self.embedding.shape[1]), np.float32)

    def texts(self, held: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self.clear()
        docs = [self.words.numbers(t) for t in held]
        if len(self.words) > self.fresh_from:
            added = list(islice(self.words, self.fresh_from, None))
            parts = word_parts(added, len(self.embedding))
            vectors = self.embedding[parts[:, 0]]
            for k in range(1, PARTS):
                vectors = vectors + self.embedding[parts[:, k]]
            self.vectors = np.concatenate([self.vectors, vectors])
            self.fresh_from = len(self.words)
        return docs


@dataclass
class ToxicityModel:
    config: ToxicityConfig
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dim, filters)
    bias: np.ndarray
    weights: np.ndarray
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, cfg: ToxicityConfig) -> "ToxicityModel":
        rng = np.random.default_rng(cfg.seed)
        embedding = rng.normal(0, 0.02, (cfg.buckets, cfg.dim)).astype(np.float32)
        embedding[PAD] = 0
        n = cfg.filters * len(cfg.widths)
        return cls(
            cfg,
            embedding,
            [rng.normal(0, 0.3, (w, cfg.dim, cfg.filters)).astype(np.float32) for w in cfg.widths],
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, n).astype(np.float32),
        )

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filter responses at each place of embedded words; the last places see padding."""
        cfg, n = self.config, len(x)
        out = np.empty((n, cfg.filters * len(cfg.widths)), np.float32)
        for k, w in enumerate(cfg.widths):
            mine = out[:, k * cfg.filters : (k + 1) * cfg.filters]
            np.matmul(x, self.filters[k][0], out=mine)
            for j in range(1, w):
                mine[: n - j] += x[j:] @ self.filters[k][j]
        return out

    def pooled(self, docs: list[np.ndarray], vectors: np.ndarray, piece: int = 50_000) -> np.ndarray:
        """Largest response of each filter over each whole text.

        A text longer than ``piece`` words is seen in pieces that look ahead
        by the widest filter, so the result does not depend on the pieces.
        """
        ahead = max(self.config.widths) - 1
        pad = np.zeros(ahead, np.int32)
        best = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        parts, owner, valid, size = [], [], [], 0

        def flush():
            nonlocal parts, owner, valid, size
            if parts:
                r = self.responses(vectors[np.concatenate(parts)])
                starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
                r[~np.concatenate(valid)] = -np.inf
                np.maximum.at(best, owner, np.maximum.reduceat(r, starts, axis=0))
            parts, owner, valid, size = [], [], [], 0

        for i, rows in enumerate(docs):
            for at in range(0, len(rows), piece):
                own = min(piece, len(rows) - at)
                seen = rows[at : at + own + ahead]
                part = np.concatenate([seen, pad])
                parts.append(part)
                owner.append(i)
                valid.append(np.arange(len(part)) < own)
                size += len(part)
                if size >= piece:
                    flush()
        flush()
        return best

    def logits(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(docs, vectors) + self.bias, 0)
        return hidden @ self.weights + self.intercept

    def score_texts(self, texts, known: _Embedded | None = None) -> np.ndarray:
        known = known or _Embedded(self.embedding)
        out = []
        for _, held in chunks(texts):
            docs = known.texts(held)
            out.append(sigmoid(self.scale * self.logits(docs, known.vectors) + self.shift))
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)

    def score(self, text: Column) -> Column:
        """Toxicity of a text column, 0 to 1; null and empty texts score alike."""
        model, memo = self, []

        def scored(batch):
            if not memo:
                memo.append(_Embedded(model.embedding))
            return pa.array(model.score_texts(batch, memo[0]), pa.float64())

        scored.__annotations__ = {"batch": pa.Array, "return": pa.Array}
        return F.arrow_udf(scored, "double")(text)

    def threshold(self, lang: Column) -> Column:
        """The language's threshold; ``cut`` for languages without one and for null."""
        out = F.lit(float(self.config.cut))
        for name, t in sorted(self.thresholds.items()):
            out = F.when(lang == name, F.lit(float(t))).otherwise(out)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels to learn from.

    A doc_id with several labels counts as toxic when one of them says so.
    """
    return (
        labels.filter(col("toxic").isin(0, 1) & col("doc_id").isNotNull())
        .filter(~held_out(col("doc_id")))
        .groupBy(col("doc_id").alias("doc_id"))
        .agg(F.max(col("toxic")).cast("int").alias("toxic"))
    )


KNOWN_BITS = 27  # of the filter by which texts without a label stay where they are
SHARD = "doc_id long, lang string, text binary, toxic int, part int, shard int"


def _arrow(fn, *inputs: str):
    """``fn`` with the annotations that say it works on Arrow tables."""
    fn.__annotations__ = {**{n: pa.Table for n in inputs}, "return": pa.Table}
    return fn


def _shards(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """All labelled rows by shard and doc_id, texts compressed; a shard is in one partition.

    Rows of part 0, a fifth, calibrate; the others train. Of rows that share a
    doc_id the first text counts. Texts are dealt out once.
    """
    ids = known.select(col("doc_id").cast("long").alias("doc_id"), "toxic")
    hashed = F.xxhash64("doc_id")
    wanted = Bits(KNOWN_BITS).joined(ids.select(hashed.alias("h")), lambda b: b.column(0).to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    lang = col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.filter(~held_out(col("doc_id"))).select(
        col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), col("text").cast("string").alias("text"))

    def labelled(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            there = sent.value.has(b.column(3).to_numpy().view(np.uint64))
            for part in slices(b.filter(pa.array(there))):
                small = [squeeze((t or "").encode("utf-8", "replace")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(small, pa.binary())],
                                                 names=["doc_id", "lang", "text"])

    part = F.crc32(F.concat(F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 5
    dealt = {"shard": F.pmod(hashed, F.lit(n)).cast("int")}
    texts = texts.withColumn("h", hashed).mapInArrow(labelled, "doc_id long, lang string, text binary").withColumns(dealt)
    ids = ids.withColumns({"part": part.cast("int"), **dealt})

    def matched(texts, ids):
        label = {d: (y, p) for d, y, p in zip(*(ids.column(c).to_pylist() for c in ("doc_id", "toxic", "part")))}
        rows = [r for r in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if r[0] in label]
        rows.sort(key=lambda r: (r[0], r[2], r[1] or ""))
        rows = [r for i, r in enumerate(rows) if not i or rows[i - 1][0] != r[0]]
        shard = ids.column("shard")[0].as_py() if len(ids) else 0
        columns = list(zip(*[(*r, *label[r[0]], shard) for r in rows])) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SHARD.split(", ")])

    count = partitions(docs, n)
    both = texts.repartition(count, "shard").groupBy("shard").cogroup(ids.repartition(count, "shard").groupBy("shard"))
    found = materialize(both.applyInArrow(_arrow(matched, "texts", "ids"), SHARD))
    sent.unpersist()
    return found


def _by_shard(batches) -> Iterable[tuple[int, pa.Table]]:
    """Whole shards of a partition, which has them one after another."""
    shard, held = None, []
    for b in batches:
        numbers = b.column(5).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                if held and numbers[start] != shard:
                    yield shard, pa.Table.from_batches(held)
                    held = []
                shard = int(numbers[start])
                held.append(b.slice(start, end - start))
    if held:
        yield shard, pa.Table.from_batches(held)


def _texts(group: pa.Table, train: bool) -> list[dict]:
    """Rows of a shard that train, or calibrate."""
    part = np.asarray(group.column("part"))
    held = group.filter(pa.array((part != 0) == train)).to_pylist()
    for r in held:
        r["text"] = zstandard.decompress(r["text"]).decode()
    return held


@dataclass
class _State:
    """Where the training of a model stands: moments of the dense parts, and of each embedding row."""

    first: list[np.ndarray]
    second: list[np.ndarray]
    seen: np.ndarray
    step: int = 0

    @classmethod
    def start(cls, model: ToxicityModel) -> "_State":
        dense = _dense(model)
        return cls(
            [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense],
            np.full(model.config.buckets, 1e-3, np.float32),
        )

    def copy(self) -> "_State":
        return _State([m.copy() for m in self.first], [v.copy() for v in self.second], self.seen.copy(), self.step)


def _dense(model: ToxicityModel) -> list[np.ndarray]:
    return [*model.filters, model.bias, model.weights]


def _copied(model: ToxicityModel) -> ToxicityModel:
    return replace(
        model, embedding=model.embedding.copy(), filters=[f.copy() for f in model.filters],
        bias=model.bias.copy(), weights=model.weights.copy(),
    )


def _flat(model: ToxicityModel, state: _State) -> np.ndarray:
    """The dense parts, their moments, the intercept and the steps in a row."""
    held = [*_dense(model), *state.first, *state.second]
    return np.concatenate([*[p.ravel() for p in held], [model.intercept, state.step]]).astype(np.float64)


def _unflatten(flat: np.ndarray, model: ToxicityModel, state: _State) -> None:
    at = 0
    for p in [*_dense(model), *state.first, *state.second]:
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    model.intercept, state.step = float(flat[at]), int(round(flat[at + 1]))


ROWS_SENT = 1024  # of the embedding, that are sent and averaged together
MOVES = "block int, shard int, n long, place binary, move binary, seen binary"


def _moves(blocks: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=[f.split()[0] for f in MOVES.split(", ")])


def _round(shards: DataFrame, model: ToxicityModel, state: _State, epochs: range) -> None:
    """``model`` and ``state`` after all shards have trained on from them for these epochs."""
    sent = shards.sparkSession.sparkContext.broadcast((model, state))
    cfg = model.config

    def trained(batches):
        for shard, group in _by_shard(batches):
            rows = _texts(group, True)
            if rows:
                yield from _moves(of_shard(shard, rows)).to_batches(max_chunksize=64)

    def of_shard(shard, rows):
        start, before = sent.value
        mine, now = _copied(start), before.copy()
        words = _Vocabulary()
        docs = [words.numbers(r["text"]) for r in rows]
        parts = np.concatenate([np.zeros((1, PARTS), np.int32), word_parts(list(words), cfg.buckets)])
        _train(mine, now, docs, parts, np.array([r["toxic"] for r in rows], np.float32), epochs, cfg.seed + shard)
        touched = np.flatnonzero(now.seen != before.seen)
        out = [(-1, shard, len(rows), b"", _flat(mine, now).tobytes(), b"")]
        for at in np.split(touched, np.flatnonzero(np.diff(touched // ROWS_SENT)) + 1) if len(touched) else []:
            move, seen = mine.embedding[at] - start.embedding[at], now.seen[at] - before.seen[at]
            place = (at % ROWS_SENT).astype(np.int16)
            out.append((int(at[0] // ROWS_SENT), shard, len(rows), place.tobytes(), move.tobytes(), seen.tobytes()))
        return out

    def averaged(batches):
        block = total = None
        for b in batches:
            for key, _, n, place, move, seen in zip(*(c.to_pylist() for c in b.columns)):
                if key != block:
                    if block is not None:
                        yield mean(block, total)
                    block = key
                    total = [0, 0.0, None] if key < 0 else [
                        np.zeros(ROWS_SENT), np.zeros((ROWS_SENT, cfg.dim)), np.zeros(ROWS_SENT)]
                if key < 0:
                    total[0] += n
                    total[1] = total[1] + n * np.frombuffer(move)
                else:
                    at = np.frombuffer(place, np.int16)
                    total[0][at] += 1
                    total[1][at] += np.frombuffer(move, np.float32).reshape(-1, cfg.dim)
                    total[2][at] += np.frombuffer(seen, np.float32)
        if block is not None:
            yield mean(block, total)

    def mean(block, total):
        n, move, seen = total
        if block < 0:
            out = (block, 0, n, b"", (move / n).tobytes(), b"")
        else:
            at = np.flatnonzero(n)
            out = (
                block, 0, len(at), at.astype(np.int16).tobytes(), (move[at] / n[at, None]).astype(np.float32).tobytes(),
                (seen[at] / n[at]).astype(np.float32).tobytes(),
            )
        return _moves([out]).to_batches()[0]

    moved = shards.mapInArrow(trained, MOVES)
    blocks = moved.repartition(partitions(moved), "block").sortWithinPartitions("block", "shard")
    got = blocks.mapInArrow(averaged, MOVES).toArrow()  # no more than the model, whatever the input
    for block, _, _, place, move, seen in zip(*(got.column(i).to_pylist() for i in range(6))):
        if block < 0:
            _unflatten(np.frombuffer(move), model, state)
        else:
            at = block * ROWS_SENT + np.frombuffer(place, np.int16).astype(np.int64)
            model.embedding[at] += np.frombuffer(move, np.float32).reshape(-1, cfg.dim)
            state.seen[at] += np.frombuffer(seen, np.float32)
    sent.unpersist()


def _train(
    model: ToxicityModel, state: _State, docs: list[np.ndarray], parts: np.ndarray, y: np.ndarray, epochs: range, seed: int
) -> None:
    """Adam on the dense parts, Adagrad on the embeddings; max pooling passes
    each gradient to the one place that gave the largest response."""
    cfg, rng = model.config, np.random.default_rng(seed)
    pad = np.zeros(max(cfg.widths) - 1, np.int32)
    dense, first, second, seen, step = _dense(model), state.first, state.second, state.seen, state.step
    for epoch in range(epochs.stop):
        order = rng.permutation(len(docs))
        if epoch < epochs.start:  # of an earlier round
            continue
        for at in range(0, len(order), cfg.batch):
            step += 1
            pick = order[at : at + cfg.batch]
            x = np.concatenate([np.concatenate([docs[i], pad]) for i in pick])
            ends = np.cumsum([len(docs[i]) + len(pad) for i in pick])
            met, x = np.unique(x, return_inverse=True)
            vectors = model.embedding[parts[met]].sum(axis=1)
            r = model.responses(vectors[x])
            place = np.zeros((len(pick), r.shape[1]), np.int64)
            top = np.full((len(pick), r.shape[1]), -1e9, np.float32)
            for k, i in enumerate(pick):
                n, start = len(docs[i]), ends[k] - len(docs[i]) - len(pad)
                if n:
                    best = r[start : start + n].argmax(axis=0)
                    place[k] = start + best
                    top[k] = r[start + best, np.arange(r.shape[1])]
            hidden = np.maximum(top + model.bias, 0)
            gap = (sigmoid(hidden @ model.weights + model.intercept) - y[pick]).astype(np.float32) / len(pick)
            back = gap[:, None] * model.weights * (hidden > 0)
            grads, rows, moves = [], [], []
            for k, w in enumerate(cfg.widths):
                own = slice(k * cfg.filters, (k + 1) * cfg.filters)
                g, p = back[:, own], place[:, own]
                part = np.zeros_like(model.filters[k])
                for j in range(w):
                    there = x[np.minimum(p + j, len(x) - 1)]
                    part[j] = np.einsum("bf,bfd->df", g, vectors[there])
                    rows.append(there.ravel())
                    moves.append((g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, cfg.dim))
                grads.append(part)
            grads += [back.sum(0), (gap[:, None] * hidden).sum(0) + 1e-4 * model.weights]
            model.intercept -= cfg.rate * float(gap.sum())
            for p, g, m, v in zip(dense, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            at_row, move = np.concatenate(rows), np.concatenate(moves)
            moved = np.any(move != 0, axis=1)
            at_row, move = parts[met[at_row[moved]]].ravel(), np.repeat(move[moved], PARTS, axis=0)
            keep = at_row != PAD
            unique, inverse = np.unique(at_row[keep], return_inverse=True)
            total = np.zeros((len(unique), cfg.dim), np.float32)
            np.add.at(total, inverse, move[keep])
            seen[unique] += (total * total).mean(axis=1)
            model.embedding[unique] -= 3 * cfg.rate * total / np.sqrt(seen[unique])[:, None]
    state.step = step


def _calibrate(model: ToxicityModel, scored: DataFrame, share: float) -> None:
    """Platt scaling weighted to the share of toxic labels, then a threshold for each language.

    ``scored`` has lang, toxic and z of all calibration rows; what is read of them are sums.
    """
    cfg = model.config
    z, y = F.col("z"), F.col("toxic")
    n, toxic, spread = scored.agg(F.count(y), F.sum(y), F.stddev_pop(z)).first()
    if not n or not 0 < toxic < n:
        return
    toxic /= n
    weight = F.when(y == 1, F.lit(share / toxic)).otherwise(F.lit((1 - share) / (1 - toxic)))

    def probability(a: float, b: float) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) * z + F.lit(b)))))

    a, b = 1.0 / (spread or 1.0), float(np.log(share / (1 - share))) if share < 1 else 0.0
    for _ in range(50):  # Newton steps with a little damping
        p = probability(a, b)
        gap, h = weight * (p - y), weight * p * (1 - p)
        gz, g, hzz, hz, hs = scored.agg(F.sum(gap * z), F.sum(gap), F.sum(h * z * z), F.sum(h * z), F.sum(h)).first()
        hess = np.array([[hzz + 0.1, hz], [hz, hs + 1e-3]])
        move = np.clip(np.linalg.solve(hess, np.array([gz + 0.1 * a, g])), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    if a <= 0:
        return
    model.scale, model.shift = round(float(a), 9), round(float(b), 9)  # sums come in any order
    p = probability(model.scale, model.shift)
    cuts = [float(t) for t in np.round(np.arange(0.1, 0.75, 0.05), 2)]
    sums = [F.sum(F.when(p >= t, v).otherwise(0.0)).alias(f"{v_}{k}") for k, t in enumerate(cuts)
            for v_, v in (("hit", weight), ("both", weight * y))]
    by_lang = (
        scored.filter(F.col("lang") != "").groupBy("lang")
        .agg(F.sum(y).alias("toxic"), F.sum(weight * y).alias("truth"), *sums)
        .filter(F.col("toxic") >= cfg.least_toxic)
    )
    for r in by_lang.collect():  # a row a language
        ranked = []
        for k, t in enumerate(cuts):
            f1 = 2 * r[f"both{k}"] / max(r[f"hit{k}"] + r["truth"], 1e-9)
            ranked.append((round(float(f1), 9), -abs(t - cfg.cut), t))  # ties: nearest to cut
        model.thresholds[r["lang"]] = max(ranked)[2]


def _calibration_scores(shards: DataFrame, model: ToxicityModel) -> DataFrame:
    """(lang, toxic, z) of the rows kept from training."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for _, group in _by_shard(batches):
            rows, known = _texts(group, False), _Embedded(sent.value.embedding)
            for at, held in chunks([r["text"] for r in rows]):
                docs = known.texts(held)
                z = sent.value.logits(docs, known.vectors).astype(np.float64)
                mine = rows[at : at + len(held)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["lang"] for r in mine], pa.string()), pa.array([r["toxic"] for r in mine], pa.int32()),
                     pa.array(z, pa.float64())],
                    names=["lang", "toxic", "z"],
                )

    return materialize(shards.mapInArrow(scored, "lang string, toxic int, z double"))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Model of all labelled rows outside the held-out quarter.

    Without toxic labels the model gives every text the score 0. Four fifths of
    the rows train the filters, a fifth calibrates.
    """
    model = ToxicityModel.start(cfg)
    known = _known(labels)
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    met = []
    if counts.get(1):
        shards = _shards(docs, known, -(-total // cfg.shard_rows))
        met = [r[0] for r in shards.select("toxic").distinct().collect()]
    if 1 not in met or 0 not in met:
        model.weights[:] = 0
        model.shift = 30.0 if 1 in met else -30.0
        return model
    state = _State.start(model)
    ends = np.linspace(0, cfg.epochs, min(cfg.rounds, cfg.epochs) + 1).astype(int).tolist()
    for start, end in zip(ends, ends[1:]):
        _round(shards, model, state, range(start, end))
    _calibrate(model, _calibration_scores(shards, model), counts[1] / total)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, rejected for every row.

    Rows with a null doc_id or text keep their row: held_out is null for a null
    id, a null text counts as empty. Repeated rows are scored each.
    """
    lang = col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select(col("doc_id").alias("doc_id"), lang.alias("lang"), model.score(col("text")).alias("score"))
    threshold = model.threshold(F.col("lang"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= model.config.cut).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"),
        (F.col("score") >= threshold).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose score stays below the threshold of their language, all columns kept."""
    name = fresh(docs, "toxicity")
    lang = col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn(name, model.score(col("text"))).filter(col(name) < model.threshold(lang)).drop(name)
