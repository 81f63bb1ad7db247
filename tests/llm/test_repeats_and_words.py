"""Collocations, substring dedup and spelling variants against brute-force versions; their answers to odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowloom.llm import collocations, licenses, simhash, spelling, substringdedup

SCHEMA = "doc_id long, text string, lang string, vec binary, rid long, `odd.name` string"
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, None, 7, "z") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sentences(seed, documents, words, vocabulary):
    random.seed(seed)
    known = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = []
    for d in range(documents):
        text = " ".join(random.choices(known, weights, k=random.randint(1, words)))
        out.append((d, re.sub(r"(w1) ", r"\1, ", text), random.choice(["en", "en", "de", None])))
    return out


# --- collocations ---


def brute_phrases(docs, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in frequent.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= covered * counts[q]}
        rows = []
        for p, a in frequent.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("sample, lowered, bits, least", [(4, 2, 27, 10), (1000, 1, 27, 3), (2, 5, 27, 3), (1, 1, 6, 3)])
def test_collocations(spark, monkeypatch, sample, lowered, bits, least):
    """Also with a sample that proposes nothing, one that proposes too much, and bits that are all set."""
    monkeypatch.setattr(collocations, "TOKENS", 700)
    docs = sentences(1, 120, 60, 60) + [(500, "À la CARTE; à la\tcarte\x0bà la  carte " * 12, "fr"), (501, None, "fr"), (502, "", None)]
    rules = collocations.Mining(least=least, sample=sample, lowered=lowered, bits=bits, top=40)
    got = collocations.collocations(frame(spark, docs + docs[:3]), rules)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs + docs[:3], least, rules.covered, 40)


def test_collocation_scores_are_exact(spark):
    data = [(3_037_000_499, 3_037_000_500, 3_037_000_501), (10**15, 10**15 + 1, 10**15 + 3), (1, 3, 1)]
    df = spark.createDataFrame(data, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations._exact_score(*(df[c] for c in "alr")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got) and len(got) == 3


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en"), (3, "once", "en")])).collect() == []


# --- substring dedup ---


def brute_strings(docs, width):
    """n_words, removed and kept of each row; documents with a smaller doc_id count, a missing one is the largest."""
    cut = [(float("inf") if d is None else d, re.findall("[^ \t-\r]+", t or "")) for d, t, _ in docs]
    first = {}
    for d, w in cut:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, float("inf")), d)
    out = []
    for (d, _, _), (order, w) in zip(docs, cut):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < order for j in range(i, i + width)}
        out.append((d or -1, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def planted(seed):
    random.seed(seed)
    word = lambda: random.choice("abcde")
    passages = [[word() for _ in range(n)] for n in (8, 9, 14, 40, 90)]
    docs = []
    for d in random.sample(range(1, 100), 60):
        text = []
        for _ in range(random.randint(0, 4)):
            text += [word() for _ in range(random.randint(0, 12))]
            p = list(random.choice(passages))
            if random.random() < 0.4:
                p[random.randrange(len(p))] = "x"
            text += p
        docs.append((d, random.choice([" ", "\n", "\t "]).join(text), "en"))
    return docs


@pytest.mark.parametrize("block, shared, seed", [(1024, 20_000, 1), (7, 2, 2), (32, 1, 3)])
def test_substring_dedup(spark, block, shared, seed):
    """Also with tiny shards, and with automata sent to several tasks."""
    docs = planted(seed)
    got = substringdedup.remove_earlier_strings(frame(spark, docs, 4), 8, block, shared).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_strings(docs, 8)
    for r in got:
        assert sum(s.n for s in r.spans) == r.n_removed


def test_substring_dedup_odd_rows(spark, empty):
    same = " ".join(f"t{i}" for i in range(70))
    long = " ".join(f"u{i % 5003}" for i in range(20_000))
    docs = [
        (1, same, "en"), (1, same, "en"), (1, "other " + same, "en"), (2, same, None), (None, same, "de"), (None, same + " end", "de"),
        (None, "alone " + long, "en"), (3, None, "en"), (4, "", "en"), (5, long, "en"), (6, "é \xa0 漢字 \x1c", "xx"), (7, same[: len(same) // 2], "en"),
    ]
    got = substringdedup.remove_earlier_strings(frame(spark, docs))
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    rows = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in got.collect())
    assert rows == brute_strings(docs, 50)
    assert [n for d, _, n, _ in rows if d == 1] == [0, 0, 0]  # rows of one doc_id do not precede each other
    assert [n for d, _, n, _ in rows if d == -1] == [70, 70, 20_000]
    assert substringdedup.remove_earlier_strings(empty).collect() == []


def test_words_before_a_missing_id_only(spark):
    same = " ".join(f"t{i}" for i in range(60))
    got = substringdedup.remove_earlier_strings(frame(spark, [(None, same, "a"), (None, same + " x", "a")])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_suffix_automaton():
    random.seed(4)
    for _ in range(60):
        text = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 30))]
        asked = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)]
        held = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        expected = [max(k for k in range(e + 1) if k == 0 or tuple(asked[e - k : e]) in held) for e in range(1, 21)]
        assert substringdedup.SuffixAutomaton(text).matching(asked) == expected


# --- spelling variants ---


def brute_near(words):
    near, by_rest = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            by_rest[i, rest].append(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in by_rest.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute_spelling(docs, rules):
    counts = Counter()
    for d, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % rules.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= rules.length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= rules.least}
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= rules.ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelled(seed, letters="abcdé"):
    random.seed(seed)
    roots = ["".join(random.choices(letters, k=random.randint(7, 12))) for _ in range(25)]
    docs = []
    for d in range(80):
        text = []
        for _ in range(60):
            w = random.choices(roots, [1 / (i + 1) ** 2 for i in range(25)])[0]
            if random.random() < 0.15:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice(letters) + w[k:], w[:k] + "Z" + w[k + 1 :]])
            text.append(random.choice([w, w, w.upper()]))
        docs.append((d, " ".join(text), "en"))
    return docs


@pytest.mark.parametrize("limit, seed", [(20_000, 1), (5, 2), (1, 3)])
def test_spelling_variants(spark, limit, seed):
    """Also with subtrees of few words."""
    docs = spelled(seed)
    rules = spelling.Spelling(limit=limit, noise=7, ratio=3)
    got = spelling.spelling_variants(frame(spark, docs), rules).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=repr) == brute_spelling(docs, rules)
    assert any(r.form for r in got) and any(r.n_near > 1 for r in got)


def test_spelling_odd_rows(spark, empty):
    huge = "q" * 300 + "x" * 40
    docs = [(None, "Straße straßen Strasse strassen", "de"), (None, None, None), (2, "", "en"), (3, "1234567 _______ ...", "en")]
    docs += [(i, f"{huge} {huge}y {huge[1:]} ÿÿÿÿÿÿÿÿ ÷×÷×÷×÷×", "xx") for i in range(10, 14)] * 2
    rules = spelling.Spelling()
    got = spelling.spelling_variants(frame(spark, docs), rules)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_spelling(docs, rules)
    assert spelling.spelling_variants(empty).collect() == []


def test_forms_follow_each_other(spark):
    data = [(f"word{i:03d}", f"word{i + 1:03d}") for i in range(19)]
    got = dict(spelling._roots(spark.createDataFrame(data, "word string, form string")).collect())
    assert set(got.values()) == {"word019"} and len(got) == 19


@pytest.mark.parametrize("leaf, crossed", [(64, 1 << 18), (1, 1 << 18), (64, 1), (1, 3)])
def test_search_finds_every_pair(monkeypatch, leaf, crossed):
    """Also down to single words, and with leaves that join halves."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "CROSSED", crossed)
    random.seed(9)
    words = sorted({"".join(random.choices("abcx", k=random.randint(3, 6))) for _ in range(600)})
    tree = spelling.Subtree([w.encode() for w in words], np.ones(len(words), bool))
    found = [(words[i], words[k]) for a, b in tree.pairs() for i, k in zip(a, b)]
    near = brute_near(set(words))
    assert len(found) == len(set(found)) and {frozenset(p) for p in found} == {frozenset((w, x)) for w in near for x in near[w]}


# --- documents told by row, not by doc_id ---

DOCS = "doc_id long, text string"
A, B = "one two three four five six", "seven eight nine ten eleven twelve"


@pytest.mark.parametrize("rows, kept", [
    ([(1, A), (2, A), (2, B)], [(1, A), (2, B)]),
    ([(1, A), (1, A), (2, A), (2, B)], [(1, A), (2, B)]),
    ([(1, A), (None, A), (None, B), (None, B), (3, None), (None, "")], [(1, A), (None, B), (3, None)]),
    ([(5, A), (5, B), (4, None), (6, "")], [(5, A), (5, B), (4, None)]),
])
def test_near_dedup_loses_no_text(spark, rows, kept):
    got = [tuple(r) for r in simhash.keep_one_of_each_group(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=repr) == sorted(kept, key=repr)


def test_license_of_its_own_row(spark):
    """Equal rows are not added up, and rows without doc_id keep apart."""
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (1, mit), (None, apache), (None, "no licence word in this text"), (2, mit), (2, apache), (3, None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = licenses.fit(docs)
    got = sorted((r.doc_id or -1, r.n_statements, tuple(r.families or ())) for r in licenses.license_scan(docs, model).collect())
    assert got == [(-1, 0, ()), (-1, 1, ("apache-2.0",)), (1, 1, ("mit",)), (1, 1, ("mit",)), (2, 1, ("apache-2.0",)), (2, 1, ("mit",)), (3, 0, ())]
