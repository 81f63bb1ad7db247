"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled once from a model file:

* the normaliser (identity models: a leading space, spaces written as the word mark);
* the pieces, as a trie over characters whose final states give piece numbers;
* byte fallback, as one arc per byte for characters that no piece holds.

Composed with a text it is a lattice whose states are places in the text. In a
merge-ordered (BPE) vocabulary two pieces may stand side by side only if the merges
of their joint characters give just these two; any other arc weighs infinity, an
allowed one its piece count of 1. One path of finite weight is left, and the
tropical shortest path finds it from left to right with one predecessor per place.

No piece reaches over the start of a run of word marks or over a line end, so the
composition falls apart there: each stretch between is a word, its path is kept in a
bounded memo, and a text's pieces are the joined paths of its words.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import chunks, col

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceTransducer:
    """Compiled transducer; small enough (one vocabulary) to ship to every task."""

    texts: list[str]
    order: dict[str, int]  # the rank at which merges give a piece
    ids: dict[str, int]
    outputs: list[bytes]
    byte_ids: list[int]
    unknown: int
    add_prefix: bool
    squeeze: bool
    trie: list = field(default_factory=lambda: [None, {}])  # number of the piece that ends here, next states
    longest: int = 1
    allowed: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)  # words of the memo before the last time it was full
    memo_words: int = 150_000
    memo_pairs: int = 500_000

    def __post_init__(self):
        # arcs run backwards: from the end of a piece to its start
        for text, number in self.ids.items():
            node = self.trie
            for c in reversed(text):
                node = node[1].setdefault(c, [None, {}])
            node[0] = number
            self.longest = max(self.longest, len(text))

    def __getstate__(self):
        return {k: ({} if k in ("allowed", "words", "older") else v) for k, v in self.__dict__.items()}

    def merges(self, text: str) -> list[str]:
        """Pieces that remain after all merges, lowest rank first, leftmost of equals."""
        parts: list[str | None] = list(text)
        following = list(range(1, len(parts))) + [-1]
        before = [-1] + list(range(len(parts) - 1))
        heap: list = []

        def offer(i):
            j = following[i]
            if j >= 0:
                rank = self.order.get(parts[i] + parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or following[i] != j or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            following[i] = following[j]
            if following[j] >= 0:
                before[following[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the arc from one piece to another has finite weight."""
        key = (left << 20) | right
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) >= self.memo_pairs:
                self.allowed.clear()
            a, b = self.texts[left], self.texts[right]
            known = self.merges(a + b) == [a, b]
            self.allowed[key] = known
        return known

    def shortest_path(self, text: str) -> list[int]:
        """Pieces of the path of finite weight through the lattice of a word."""
        n, back = len(text), text[::-1]
        last: list = [None] * (n + 1)  # piece or fallback with which the path to each place ends
        trie, longest, known = self.trie, self.longest, self.allowed.get
        for end in range(1, n + 1):
            node, at, found = trie, end, None
            for c in back[n - end : n - end + longest]:
                node = node[1].get(c)
                if node is None:
                    break
                at -= 1
                piece = node[0]
                if piece is None:
                    continue
                if at:
                    left = last[at]
                    if left is None:
                        continue
                    if left >= 0:
                        finite = known((left << 20) | piece)
                        if not (self.may_follow(left, piece) if finite is None else finite):
                            continue
                found = piece
                break  # no other arc into this place has finite weight
            if found is None and text[end - 1] not in self.ids and (end == 1 or last[end - 1] is not None):
                found = -1
            last[end] = found
        if last[n] is None:  # only where equal ranks make the arcs depend on more than a pair
            return self.merged(text)
        path: list[int] = []
        end = n
        while end > 0:
            piece = last[end]
            if piece < 0:
                path.extend(reversed(self.fallback(text[end - 1])))
                end -= 1
            else:
                path.append(piece)
                end -= len(self.texts[piece])
        return path[::-1]

    def merged(self, text: str) -> list[int]:
        """Numbers of what all merges leave; characters of no piece by their bytes."""
        return [i for p in self.merges(text) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def fallback(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def word(self, text: str) -> bytes:
        """Piece numbers of a word as packed 32-bit integers."""
        path = self.words.get(text) or self.older.get(text)
        if path is None:
            marks = len(text) - len(text.lstrip(MARK))
            # runs of marks merge with equal rank, from the left
            runs = marks > 2 or marks == 2 and len(text) == 2
            path = array("i", self.merged(text) if runs else self.shortest_path(text)).tobytes()
        if len(text) <= 64:
            if len(self.words) >= self.memo_words:  # words met again since then move on, others go
                self.words, self.older = {}, self.words
            self.words[text] = path
        return path

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((MARK if self.add_prefix else "") + text).replace(" ", MARK)

    def encode(self, text: str) -> np.ndarray:
        known, word = self.words, self.word
        parts = []
        for w in WORDS.findall(self.normalise(text)):
            parts.append(known.get(w) or word(w))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.outputs.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


# a run of marks with the word behind it, or a line end; nothing joins over these borders
WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


_shared: dict = {}  # a Python worker keeps one transducer with its memos from task to task


def shared(transducer: PieceTransducer) -> PieceTransducer:
    """The worker's own copy of an equal transducer, with what it has remembered."""
    key = hash((tuple(transducer.texts), transducer.add_prefix, transducer.squeeze))
    if key not in _shared:
        _shared.clear()
        _shared[key] = transducer
        gc.freeze()  # its states live as long as the worker: not to be walked at every collection
    return _shared[key]


def compile_model(path: str = MODEL_PATH) -> PieceTransducer:
    """Transducer of a model file. Raises for models it cannot follow exactly."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, kind, add_prefix, squeeze, charsmap = [], 1, True, True, b""
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            score = float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0
            pieces.append((p[1].decode(), score, p.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif number == 3:
            spec = dict(_fields(value))
            charsmap, add_prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if kind != 2 or charsmap or any(k == USER_DEFINED for *_, k in pieces):
        raise ValueError("only merge-ordered models with an identity normaliser and no fixed pieces are compiled")
    ids = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
    if any(MARK in t.lstrip(MARK) or "\n" in t and len(t) > 1 for t in ids):
        raise ValueError("a piece reaches over a word border")
    outputs, byte_ids, unknown = [], {}, 0
    for i, (t, _, k) in enumerate(pieces):
        if k == BYTE:
            byte_ids[int(t[1:-1], 16)] = i
            outputs.append(bytes([int(t[1:-1], 16)]))
        elif k == NORMAL:
            outputs.append(t.replace(MARK, " ").encode())
        else:
            unknown = i if k == UNKNOWN else unknown
            outputs.append(" ⁇ ".encode() if k == UNKNOWN else b"")
    rank = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
    return PieceTransducer(
        [t for t, *_ in pieces],
        {t: rank[pieces[i][1]] for t, i in ids.items()},
        ids,
        outputs,
        [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
        unknown,
        add_prefix,
        squeeze,
    )


def encode_documents(docs: DataFrame, transducer: PieceTransducer) -> DataFrame:
    """doc_id, n_pieces, n_fallback, round_trip, pieces for every row.

    One narrow stage, no shuffle. Null and empty texts have no pieces. round_trip
    tells whether decoding gives the text back; it is true for every text that
    the normaliser leaves whole.
    """

    def encoded(batches):
        model = shared(transducer)
        is_byte = np.zeros(len(model.texts), bool)
        is_byte[model.byte_ids] = True
        for b in batches:
            ids = b.column(0)
            for start, held in chunks(b.column(1)):
                pieces = [model.encode(t) for t in held]
                ends = np.cumsum([0] + [len(p) for p in pieces])
                flat = np.concatenate(pieces) if pieces else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(held)),
                        pa.array(np.diff(ends), pa.int32()),
                        pa.array([int(is_byte[p].sum()) for p in pieces], pa.int32()),
                        pa.array([model.decode(p) == t for p, t in zip(pieces, held)], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    ],
                    names=["doc_id", "n_pieces", "n_fallback", "round_trip", "pieces"],
                )

    return docs.select(col("doc_id").alias("doc_id"), col("text").cast("string").alias("text")).mapInArrow(
        encoded, "doc_id long, n_pieces int, n_fallback int, round_trip boolean, pieces array<int>"
    )


def decode_documents(encoded: DataFrame, transducer: PieceTransducer) -> DataFrame:
    """doc_id and the text that ``pieces`` stand for; null pieces give an empty text."""

    def decoded(batches):
        for b in batches:
            lists = b.column(1)
            texts = [
                transducer.decode(np.asarray(x.values, np.int32)) if x.is_valid else "" for x in lists
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(col("doc_id").alias("doc_id"), F.col("pieces")).mapInArrow(
        decoded, "doc_id long, text string"
    )
