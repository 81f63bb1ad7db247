"""Phrase collocations by Toivonen's sampling, with exact counts over all texts.

A phrase is frequent if it occurs often enough in its language; so are its parts then.

1. A sample of the documents, with a lowered threshold, proposes frequent words and pairs.
2. A full pass counts exactly every occurrence of a proposed phrase and of the negative
   border: phrases that were not proposed though all their parts were (all words, pairs
   of proposed words, triples of proposed pairs).
3. Where a border phrase turns out frequent, phrases above it were never counted. Further
   full passes count what the new phrases open up, and nothing else, until a pass opens
   nothing.

Proposals travel as a table of bits of fixed size, one bit a phrase by its hash. Phrases
that share a bit with a proposed one are counted too, so the table can only cause more
counting, never less; a pass is closed when its frequent phrases set no new bit. Tasks
count runs of words as numbers and send each phrase once for a run of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.common import Bits, chunks, col, partitions, written
from flowloom.operators import skew

# fixed values: where a piece ends, and what parts words inside it
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PARTS = b" \t"

_TABLE = bytes.maketrans(
    PIECE_ENDS + PARTS + bytes(range(65, 91)), b"\n" * len(PIECE_ENDS) + b" " * len(PARTS) + bytes(range(97, 123))
)
END, NOTHING = -1, -2
TOKENS = 2_000_000  # of one language, counted at a time
SENT = 1 << 16  # rows of a batch
COUNTED = "key string, f long"  # phrase, line feed (no phrase holds one), language


@dataclass(frozen=True)
class Mining:
    """Phrases of ``least`` occurrences; one document of ``sample`` proposes, ``lowered`` times there suffice."""

    least: int = 10
    covered: int = 50  # percent of its occurrences that a longer phrase may not have
    top: int = 2000
    sample: int = 4
    lowered: int = 2
    bits: int = 27


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word, 11)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Language:
    """Words of one language as a task meets them."""

    def __init__(self):
        self.known = {b"": NOTHING, b"\n": END}
        self.held, self.size = [], 0

    def add(self, text: str) -> None:
        parts = text.encode("utf-8", "replace").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        known = self.known
        ids = [known.setdefault(w, len(known) - 2) for w in parts]
        ids.append(END)
        self.held.append(np.array(ids, np.int64))
        self.size += len(ids)

    def taken(self) -> tuple[np.ndarray, list[bytes]]:
        run = np.concatenate(self.held)
        words = list(self.known)[2:]
        self.__init__()
        return run[run != NOTHING], words


def _counts(run: np.ndarray, words: list[bytes], lang: str, now: Bits | None, before: Bits | None, sizes: int):
    """(phrases, counts) of what this pass counts in a run of word numbers; all words have an empty phrase."""
    v = len(words)
    if not v:
        return
    text = pa.array(words, pa.binary())
    first_pass = before is None
    if first_pass:
        f = np.bincount(run[run >= 0], minlength=v)
        yield pa.array([b""], pa.binary()), np.array([f.sum()])
        yield text, f
    if len(run) < 2:
        return
    hashes = np.array([word_hash(lang, w) for w in words], np.uint64)
    left, right = run[:-1], run[1:]
    both = (left >= 0) & (right >= 0)

    def open_pairs(bits):
        known = np.append(bits.has(hashes), False)  # the last place stands for an end
        return both & known[left] & known[right]

    def new(find):
        """Places open in this pass and in none before it."""
        if now is None:
            return None
        return find(now) if first_pass else find(now) & ~find(before)

    pairs = both if now is None else new(open_pairs)
    key, f = np.unique(left[pairs] * v + right[pairs], return_counts=True)
    if len(key):
        yield pc.binary_join_element_wise(text.take(pa.array(key // v)), text.take(pa.array(key % v)), b" "), f
    if sizes < 3 or now is None:
        return
    hashed = np.zeros(len(left), np.uint64)
    hashed[both] = pair_hash(hashes[left[both]], hashes[right[both]])

    def open_triples(bits):
        known = both & bits.has(hashed)
        return known[:-1] & known[1:]

    at = np.flatnonzero(new(open_triples))
    pair, number = np.unique(left[at] * v + right[at], return_inverse=True)
    key, f = np.unique(number * v + run[at + 2], return_counts=True)
    if len(key):
        pair = pair[key // v]
        parts = [text.take(pa.array(x)) for x in (pair // v, pair % v, key % v)]
        yield pc.binary_join_element_wise(*parts, b" "), f


def _pass(texts: DataFrame, now=None, before=None, sizes: int = 3) -> DataFrame:
    """key, f of one pass over ``texts``; ``now`` and ``before`` are broadcast bits."""

    def told(lang, held):
        run, words = held.taken()
        bits = now.value if now is not None else None
        old = before.value if before is not None else None
        of_lang = pa.scalar(lang.encode("utf-8", "replace"))
        for phrases, f in _counts(run, words, lang, bits, old, sizes):
            for at in range(0, len(f), SENT):
                key = pc.binary_join_element_wise(phrases[at : at + SENT], of_lang, b"\n").cast(pa.string())
                yield pa.RecordBatch.from_arrays([key, pa.array(f[at : at + SENT].astype(np.int64))], names=["key", "f"])

    def rows(batches):
        held: dict[str, _Language] = {}
        for b in batches:
            langs = b.column(0)
            for start, part in chunks(b.column(1)):
                for i, t in enumerate(part, start):
                    if not t:
                        continue
                    lang = langs[i].as_py()
                    own = held.get(lang)
                    if own is None:
                        own = held[lang] = _Language()
                    own.add(t)
                    if own.size >= TOKENS:
                        yield from told(lang, held.pop(lang))
                if sum(x.size for x in held.values()) >= 2 * TOKENS:
                    lang = max(held, key=lambda k: held[k].size)
                    yield from told(lang, held.pop(lang))
        for lang, own in held.items():
            yield from told(lang, own)

    # most phrases come once from a run of texts: they are dealt out before they are added up
    return texts.mapInArrow(rows, COUNTED).repartition("key").groupBy("key").agg(F.sum("f").alias("f"))


def _named(counts: DataFrame) -> DataFrame:
    phrase = F.substring_index("key", "\n", 1)
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    lang = F.substring(F.col("key"), F.length(phrase) + 2, F.length("key"))
    return counts.select(lang.alias("lang"), size.alias("size"), phrase.alias("phrase"), "f")


def _with_phrases(bits: Bits, phrases: DataFrame) -> tuple[Bits, bool]:
    """``bits`` with those of words and pairs, and whether any was new."""

    def hashes(b):
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        parts = [[word_hash(g, w) for w in t.encode("utf-8", "replace").split(b" ")] for g, t in zip(langs, texts)]
        first = np.array([p[0] for p in parts], np.uint64)
        last = np.array([p[-1] for p in parts], np.uint64)
        one = np.array([len(p) == 1 for p in parts], bool)
        return np.where(one, first, pair_hash(first, last))

    more = bits.joined(phrases.filter(F.col("size").isin(1, 2)).select("lang", "phrase"), hashes)
    return more, bool((more.words != bits.words).any())


def frequent_phrases(docs: DataFrame, rules: Mining = Mining()) -> DataFrame:
    """lang, size, phrase, f: words and phrases of up to three words with ``least`` occurrences;
    size 0 holds the number of words of a language."""
    spark = docs.sparkSession
    lang = F.coalesce(col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), col("text").cast("string").alias("text"))
    drawn = F.pmod(F.xxhash64(col("doc_id").cast("string"), col("text").cast("string")), F.lit(rules.sample)) == 0
    sampled = docs.filter(drawn).select(lang.alias("lang"), col("text").cast("string").alias("text"))
    proposed = _named(_pass(sampled, sizes=2).filter(F.col("f") >= rules.lowered))
    now, _ = _with_phrases(Bits(rules.bits), proposed)
    before, tables = None, []
    while True:
        sent = spark.sparkContext.broadcast(now)
        counted = _pass(texts, sent, before)
        frequent = (F.col("f") >= rules.least) | F.startswith("key", F.lit("\n"))
        kept = written(_named(counted.filter(frequent)), "phrases")
        tables.append(kept)
        if before is not None:
            before.unpersist()
        before = sent
        now, opened = _with_phrases(now, kept)
        if not opened:
            break
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits: counts up to 10 ** 15 fit."""
    wide = [c.cast("decimal(16,0)").cast("decimal(38,0)") for c in (a, left, right)]
    top = F.lit(1_000_000).cast("decimal(38,0)") * wide[0] * wide[0]
    return F.call_function("div", top, wide[1] * wide[2])


def _scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score: the cut with the lowest score counts, ties to the shorter first part."""
    part = lambda n: F.substring_index("phrase", " ", n)
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1, part(1), part(-1)))).otherwise(
        F.array(cut(1, part(1), part(-2)), cut(2, part(2), part(-1)))
    )
    asked = found.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"), F.inline(cuts))
    side = lambda key, out: found.filter("size in (1, 2)").select(
        "lang", F.col("phrase").alias(key), F.col("f").alias(out)
    )
    both = asked.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    scored = both.withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return scored.groupBy("lang", "size", "phrase", "a").agg(lowest).select(
        "lang", "size", "phrase", "a", "m.l", "m.r", "m.score"
    )


def _uncovered(found: DataFrame, scored: DataFrame, covered: int) -> DataFrame:
    """Without phrases most of whose occurrences lie in one longer frequent phrase."""
    ends = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    longer = found.filter("size = 3").select("lang", F.explode(ends).alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(F.col("_longer") * 100 < F.col("a") * covered, F.lit(True))).drop("_longer")


def collocations(docs: DataFrame, rules: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of each language.

    Letters A-Z count as lower case. A null lang is ``und``; null and empty texts have no
    words; repeated rows count each time; other columns are ignored. Ties of score and
    count go by the bytes of the phrase. Without a frequent phrase there are no rows.
    """
    found = frequent_phrases(docs, rules)
    left = written(_uncovered(found, _scored(found), rules.covered), "collocations")
    # a language may hold most phrases: the best of each part first, then the best of those
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs, 8)))
    inside = Window.partitionBy("lang", "_part").orderBy(*order)
    best = (
        left.withColumn("_part", part)
        .withColumn("_in", F.row_number().over(inside))
        .filter(F.col("_in") <= rules.top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .filter(F.col("rank") <= rules.top)
    )
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return skew.lookup(best, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
