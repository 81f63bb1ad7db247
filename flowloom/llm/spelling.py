"""Spelling variants: words one edit apart, grouped under a much more frequent form.

Near words are found with a trie of frequency vectors. The vector of a word counts its
letters group by group; a level of the trie is a group, a branch a count. One inserted,
deleted or replaced letter raises at most one count by one (surplus) and lowers at most
one by one (deficit), so a search goes down the trie with a budget of one surplus and one
deficit, depth first, and gives up a branch when either is overspent. The words of the
leaves it reaches are verified letter by letter.

The trie is dealt out by its own nodes: a node of more than ``limit`` words is parted into
its children, so tasks hold subtrees of bounded size. Only nodes above that size are known
to all tasks (at most one for every ``limit`` words and level). A word lives in one subtree
and visits, by the same search over the parted nodes, those with a higher number that its
budget reaches, so a pair of words meets once. Inside a task words that reach a node go
down together, as arrays. Leaves of very many words join halves: of two words one edit
apart, the first or the last halves are equal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import chunks, col, written
from flowloom.operators import skew

# fixed values: the letters of a word, and groups of letters (all others are the last group)
RUN = "[A-Za-zÀ-ÿ]"
GROUPS = ("e", "a", "i", "n", "o", "t", "r", "s", "u", "l", "d", "h", "é", "è", "cm", "bfgp", "jkqvwxyz", "")

LEVELS = len(GROUPS)
LEAF = 64  # words under a node that are compared without going deeper
CROSSED = 1 << 18  # pairs of a leaf beyond which halves are joined
WIDE = 48  # letters up to which words are compared as rows of a matrix
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Spelling:
    """Words have ``length`` letters and ``least`` occurrences; a form has ``ratio`` times those of the word.

    In one of ``noise`` runs, by a hash of document and run, one letter is left out.
    """

    length: int = 7
    least: int = 2
    ratio: int = 10
    noise: int = 31
    limit: int = 20_000


def word_counts(docs: DataFrame, rules: Spelling = Spelling(), most: int = 300_000) -> DataFrame:
    """word, n: occurrences of words over whole texts; null texts have none, a null doc_id is an empty number."""
    runs = re.compile(f"{RUN}{{{rules.length},}}")

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
        )

    def counted(batches):
        held: Counter = Counter()
        for b in batches:
            ids = b.column(0)
            for start, texts in chunks(b.column(1)):
                for i, t in enumerate(texts, start):
                    before = zlib.crc32(f"{ids[i].as_py() or ''}:".encode())
                    for run, n in Counter(runs.findall(t.translate(LOWER))).items():
                        h = zlib.crc32(run.encode(), before)
                        if h % rules.noise == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < rules.length:
                                continue
                        held[run] += n
                if len(held) >= most:
                    yield told(held)
                    held = Counter()
        yield told(held)

    texts = docs.select(col("doc_id").cast("string").alias("id"), col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= rules.least)


# --- frequency vectors ---


def _group_of_byte() -> np.ndarray:
    table = np.full(256, LEVELS - 1, np.uint8)
    for g, letters in enumerate(GROUPS):
        for letter in letters:
            table[ord(letter)] = g
    return table


GROUP_OF = _group_of_byte()


def frequency_vectors(words: list[bytes]) -> np.ndarray:
    """Counts of each letter group; they stop at 255, which brings vectors closer, never apart."""
    sizes = np.array([len(w) for w in words], np.int64)
    groups = GROUP_OF[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * LEVELS + groups
    return np.minimum(np.bincount(at, minlength=len(words) * LEVELS), 255).reshape(-1, LEVELS).astype(np.uint8)


def _with_vectors(words: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            data = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            vectors = frequency_vectors(data)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["word", "n", "vec"],
            )

    return words.mapInArrow(rows, "word string, n long, vec binary")


class PartedNodes:
    """Trie nodes of more than ``limit`` words, by number; their other children are the subtrees of tasks."""

    def __init__(self, prefixes: list[bytes]):
        order = sorted(prefixes, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(order)}
        inner = sorted((number[p[:-1]] * 256 + p[-1], number[p]) for p in order if p)
        self.any = bool(order)
        self.keys = np.array([k for k, _ in inner], np.int64)
        self.numbers = np.array([n for _, n in inner], np.int64)

    def reached(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, subtree, at home) for the home of each word and the higher subtrees within its budget."""
        words = np.arange(len(vectors))
        if not self.any:
            return words, np.full(len(words), -1), np.ones(len(words), bool)
        found, state = [], [words, np.zeros(len(words), np.int64), np.zeros(len(words), int), np.zeros(len(words), int)]
        for level in range(LEVELS):
            onward = []
            for step in (-1, 0, 1):
                word, node, surplus, deficit = state
                count = vectors[word, level].astype(np.int64) + step
                surplus, deficit = surplus + (step > 0), deficit + (step < 0)
                ok = (count >= 0) & (count <= 255) & (surplus <= 1) & (deficit <= 1)
                word, key = word[ok], node[ok] * 256 + count[ok]
                surplus, deficit = surplus[ok], deficit[ok]
                if len(self.keys) and level + 1 < LEVELS:
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    deeper = self.keys[at] == key
                    onward.append([x[deeper] for x in (word, self.numbers[at], surplus, deficit)])
                else:
                    deeper = np.zeros(len(key), bool)
                ends = ~deeper
                found.append((word[ends], key[ends], ((surplus == 0) & (deficit == 0))[ends]))
            state = [np.concatenate(x) for x in zip(*onward)] if onward else []
            if not state or not len(state[0]):
                break
        word, key, home = (np.concatenate(x) for x in zip(*found))
        own = np.empty(len(vectors), np.int64)
        own[word[home]] = key[home]
        up = key >= own[word]
        return word[up], key[up], home[up]


def parted_nodes(words: DataFrame, limit: int) -> PartedNodes:
    """Nodes too large for a task, counted over all levels in one partial aggregation."""
    vectors = words.groupBy("vec").agg(F.count(F.lit(1)).alias("n"))
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda d: F.substring(F.col("vec"), F.lit(1), d))
    counts = vectors.select("n", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.sum("n").alias("n"))
    total = words.count()
    cut = max(limit, total // skew.MAX_HOT_GROUPS)
    return PartedNodes([bytes(r[0]) for r in counts.filter(F.col("n") > cut).select("prefix").toLocalIterator()])


# --- search inside a subtree ---


def one_edit_apart(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class Subtree:
    """The words of a task: those at home make up the trie, all of them search it."""

    def __init__(self, words: list[bytes], home: np.ndarray):
        self.words, self.home = words, home
        self.vectors = frequency_vectors(words)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.short = self.sizes <= WIDE
        self.letters = np.zeros((len(words), WIDE + 1), np.uint8)
        for i in np.flatnonzero(self.short):
            self.letters[i, : self.sizes[i]] = np.frombuffer(words[i], np.uint8)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (searching word, word at home) one edit apart, each pair once."""
        members = np.flatnonzero(self.home)
        members = members[np.lexsort(self.vectors[members].T[::-1])]
        every = np.arange(len(self.words))
        zero = np.zeros(len(every), np.int8)
        stack = [(0, members, every, zero, zero)]
        while stack:
            level, members, seekers, surplus, deficit = stack.pop()
            if not len(seekers):
                continue
            if level == LEVELS or len(members) <= LEAF:
                yield from self._leaf(members, seekers)
                continue
            counts = self.vectors[members, level]
            cuts = np.flatnonzero(np.diff(counts)) + 1
            own = self.vectors[seekers, level].astype(np.int16)
            for group in np.split(members, cuts):
                step = int(self.vectors[group[0], level]) - own
                more, less = surplus + (step == 1), deficit + (step == -1)
                ok = (np.abs(step) <= 1) & (more <= 1) & (less <= 1)
                stack.append((level + 1, group, seekers[ok], more[ok].astype(np.int8), less[ok].astype(np.int8)))

    def _leaf(self, members, seekers):
        if len(members) * len(seekers) > CROSSED:
            candidates = self._halves(members, seekers)
        else:
            candidates = [(np.repeat(seekers, len(members)), np.tile(members, len(seekers)))]
        for a, b in candidates:
            once = ~self.home[a] | (a < b)
            a, b = a[once], b[once]
            change = self.vectors[a].astype(np.int16) - self.vectors[b]
            near = (np.maximum(change, 0).sum(1) <= 1) & (np.minimum(change, 0).sum(1) >= -1)
            a, b = a[near], b[near]
            ok = self._verified(a, b)
            yield a[ok], b[ok]

    def _halves(self, members, seekers, most: int = CROSSED):
        """Pairs of equal first or last halves, cut for the shorter word of two lengths."""

        def keys(side):
            """Both halves of a word as the shorter of two (or of equal length), and as the longer."""
            out = []
            for w in (self.words[i] for i in side.tolist()):
                for n in (len(w), len(w) - 1):
                    k = n // 2
                    out += [hash((n, 0, w[:k])), hash((n, 1, w[len(w) - (n - k) :]))]
            return np.array(out, np.int64).reshape(-1, 4)

        mine, theirs = keys(seekers), keys(members)
        joins = [(mine[:, i], theirs[:, k]) for i, k in ((0, 0), (1, 1), (2, 0), (3, 1), (0, 2), (1, 3))]
        found = []
        for left, right in joins:
            order = np.argsort(right, kind="stable")
            lo, hi = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
            n = hi - lo
            a = np.repeat(np.arange(len(left)), n)
            b = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append(a * len(members) + b)
        seen = np.unique(np.concatenate(found))
        for at in range(0, len(seen), most):
            part = seen[at : at + most]
            yield seekers[part // len(members)], members[part % len(members)]

    def _verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        long = ~(self.short[a] & self.short[b])
        for i in np.flatnonzero(long).tolist():
            out[i] = one_edit_apart(self.words[a[i]], self.words[b[i]])
        swap = self.sizes[a] > self.sizes[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n, more = self.sizes[a], self.sizes[b] - self.sizes[a]
        for at in range(0, len(a), CROSSED):
            part = slice(at, at + CROSSED)
            x, y = self.letters[a[part]], self.letters[b[part]]
            inside = np.arange(WIDE)[None] < n[part, None]
            differ = (x[:, :WIDE] != y[:, :WIDE]) & inside
            shifted = (x[:, :WIDE] != y[:, 1:]) & inside
            first = np.where(differ.any(1), differ.argmax(1), n[part])
            last = np.where(shifted.any(1), WIDE - 1 - shifted[:, ::-1].argmax(1), -1)
            same = (more[part] == 0) & (differ.sum(1) == 1)
            out[part] |= ~long[part] & (same | ((more[part] == 1) & (last < first)))
        return out


NEAR = "word string, n_near long, form_n long, form string"


def _search(group: pa.Table) -> pa.Table:
    """For each word of a subtree that has near words here: how many, and the most frequent of them."""
    words = [w.encode("latin-1") for w in group.column("word").to_pylist()]
    n = group.column("n").to_numpy()
    tree = Subtree(words, group.column("home").to_numpy(zero_copy_only=False))
    found = list(tree.pairs())
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    left, right = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[right], -n[right], left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else left
    near = np.diff(np.append(first, len(left)))
    text = lambda at: pa.array([words[i].decode("latin-1") for i in at.tolist()], pa.string())
    return pa.table(
        [text(left[first]), pa.array(near, pa.int64()), pa.array(n[right[first]], pa.int64()), text(right[first])],
        names=["word", "n_near", "form_n", "form"],
    )


def near_words(words: DataFrame, limit: int = Spelling.limit) -> DataFrame:
    """word, n_near, form, form_n of words that have near ones; ``words`` has word and n, each word once."""
    words = written(_with_vectors(words), "spelling-words")
    nodes = parted_nodes(words, limit)

    def dealt(batches):
        for b in batches:
            vectors = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, LEVELS)
            word, key, home = nodes.reached(vectors)
            at = pa.array(word)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(key, pa.int64()), pa.array(home)],
                names=["word", "n", "key", "home"],
            )

    met = words.mapInArrow(dealt, "word string, n long, key long, home boolean")
    found = met.groupBy("key").applyInArrow(_search, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("o"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.o")).alias("form_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each other; a form has many times the occurrences of
    its word, so chains are short, and each round doubles the steps taken."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        joined = written(joined, "spelling-roots")
        links = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts.

    Null and empty texts have no words; repeated rows count each time; columns beside
    doc_id and text are ignored. A table without words gives no rows. Of near words
    with equal counts the smaller in code-point order is the form.
    """
    words = written(word_counts(docs, rules), "spelling-counts")
    near = near_words(words, rules.limit)
    enough = F.col("form_n") >= F.col("n") * rules.ratio
    told = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"),
        ),
        "spelling-near",
    )
    roots = _roots(told.filter(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
