"""License scans: a trained paragraph classifier, in SQL functions and Spark ML only.

A paragraph is a line of the text. Its words, pairs and triples of words are hashed
into a sparse vector, and a multinomial logistic regression tells the licence family,
``unknown`` for a licence statement of no known family, or ``none``. It is trained on
statements made from patterns and licence names and on a bounded, documented sample
of lines of the corpus. The probability that a family needs is calibrated by a first fit that
sees neither the names nor the patterns kept back; below it the paragraph is ``unknown``.
A prediction counts as confirmed when enough of the words and pairs of words of one of the
family's templates stand in the paragraph. An identifier such as Apache-2.0 or GPLv2 is a template by itself, a plain word such as MIT
is one only where the words around it state a licence.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm.common import col, fresh
from flowloom.llm.linededup import with_rid
from flowloom.session import materialize

NONE, UNKNOWN = "none", "unknown"

# --- fixed values: names of public licences by family, and ways to state them ---
NAMES = {
    "mit": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "apache-2.0": [
        "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License, version 2.0",
    ],
    "gpl": [
        "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3",
        "GNU General Public License as published by the Free Software Foundation", "GPL-3.0-or-later", "GPLv2",
    ],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-2.1"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0"],
    "isc": ["ISC License", "ISC licence"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 License"],
    "public-domain": ["CC0 1.0 Universal", "public domain dedication", "the Unlicense"],
}
CLAUSES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "public-domain": ["This is free and unencumbered software released into the public domain"],
}
STATEMENTS = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This software is distributed under the terms of the {}", "Published under {}.", "License: {}",
    "SPDX-License-Identifier: {}", "The code is available under the {}, see the file LICENSE.",
    "This document is made available under a {}.", "All content is licensed under {} unless noted otherwise.",
    "Copyright 2019 the authors. Licensed under the {}", "{} applies to this program.", "The project is covered by the {}.",
]
UNKNOWN_NAMES = [
    "Acme Public License, version 1", "Example Corporation End User Agreement", "Open Data Terms 3.1", "FooBar Licence",
    "Community Source Agreement", "Zeta Research License 2.2", "Vendor Proprietary License", "custom terms",
    "Sunrise Software License, Version 4", "a commercial licence", "University Academic License", "Nova Public License",
    "Artistic License 2.0", "European Union Public Licence", "Microsoft Public License", "zlib License",
]
PLAIN = [
    "The driver needs a valid license to drive.", "Her fishing licence was renewed in May.", "He studied copyright law.",
    "The public library opens at nine.", "A general was promoted in the public square.", "Version 2.0 of the report is late.",
    "The software was installed without any problem.", "An attribution of the painting is open.", "Free of charge parking.",
    "The commons are creative places.", "The plate on the car is a license plate.", "They released the new album.",
    "The foundation published its report under the old name.", "GNU are large antelopes.", "The licensed pub is closed.",
    "There is no licence in the box.", "Nobody asked for a license today.", "The word licence is a noun.",
    "This text says nothing about a licence.", "A licence fee is due in this year.", "He lost his licence on the way.",
]
# --- end of fixed values ---


@dataclass(frozen=True)
class LicenseRule:
    """``plain_rows`` bounds the corpus lines of the fit, ``kept_back`` is one name, pattern or line in so many."""

    features: int = 1 << 14
    plain_rows: int = 3000
    kept_back: int = 4
    iterations: int = 25
    penalty: float = 1e-5
    precision: float = 0.98
    confirm: float = 0.6


@dataclass
class LicenseModel:
    rule: LicenseRule
    pipeline: PipelineModel
    labels: list[str]
    least: float = 0.5
    templates: dict[str, list[list[str]]] = field(default_factory=dict)


def words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum() or c in ".+-":
            word += c
        elif word:
            out.append(word.strip(".-") or word)
            word = ""
    return [w for w in out if w]


def _features(rule: LicenseRule) -> list:
    return [
        RegexTokenizer(inputCol="paragraph", outputCol="raw", pattern=r"[^\p{L}\p{N}.+-]+", toLowercase=True),
        SQLTransformer(statement="SELECT *, transform(raw, w -> trim(BOTH '.-' FROM w)) AS w1 FROM __THIS__"),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        NGram(n=3, inputCol="w1", outputCol="w3"),
        SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS grams FROM __THIS__"),
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=rule.features, binary=True),
        Normalizer(inputCol="counts", outputCol="features"),
    ]


def _drawn(texts: list[str], one_in: int) -> set[str]:
    """One in ``one_in`` texts, rounded up, by their hashes; none of a single text."""
    n = -(-len(texts) // one_in) if len(texts) > 1 else 0
    return set(sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t))[:n])


def names_kept_back(rule: LicenseRule) -> set[str]:
    """Names, of known families and of none, that the fit for the calibration does not see."""
    return set().union(*[_drawn(names, rule.kept_back) for names in [*NAMES.values(), UNKNOWN_NAMES]])


def _statements(rule: LicenseRule) -> list[tuple[str, str, bool, bool]]:
    """(family, text, whether the first fit sees it, whether it calibrates).

    A statement calibrates if its name was kept back, under whatever pattern.
    """
    names_back, patterns_back = names_kept_back(rule), _drawn(STATEMENTS, rule.kept_back)
    named = [(f, n) for f, names in [*NAMES.items(), (UNKNOWN, UNKNOWN_NAMES)] for n in names]
    made = [
        (f, s.format(n), n not in names_back and s not in patterns_back, n in names_back) for f, n in named for s in STATEMENTS
    ]
    clauses = [(f, c, True, False) for f, cs in CLAUSES.items() for c in cs for _ in range(4)]
    return made + clauses + [(NONE, p, True, False) for p in PLAIN for _ in range(3)]


def _templates(but: set[str] = frozenset()) -> dict[str, list[list[str]]]:
    return {f: [words_of(t) for t in [n for n in names if n not in but] + CLAUSES.get(f, [])] for f, names in NAMES.items()}


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, paragraph): the lines of every whole text, blank ones left out."""
    lines = F.split(F.coalesce(col("text").cast("string"), F.lit("")), "\n", -1)
    return (
        docs.select(col("doc_id").alias("doc_id"), F.posexplode(lines).alias("place", "paragraph"))
        .filter(F.trim("paragraph") != "")
    )


def fit(docs: DataFrame, rule: LicenseRule = LicenseRule()) -> LicenseModel:
    """Model of the fixed statements and of ``plain_rows`` corpus lines drawn by hash.

    Lines that mention a licence word are no examples of class none. A first fit, without the
    names, patterns and lines kept back and without templates of those names, fixes the
    probability that a family needs; the model itself is fitted on all of them.
    """
    spark = docs.sparkSession
    labels = [NONE, UNKNOWN, *NAMES]
    made = _literal(spark, [(labels.index(f), t, seen, back) for f, t, seen, back in _statements(rule)])
    back = F.pmod(F.xxhash64("paragraph"), F.lit(rule.kept_back)) == 0
    plain = (
        paragraphs(docs)
        .filter(~F.lower("paragraph").rlike("licen|copyright|public domain|permission|spdx|creative commons|creativecommons|warrant"))
        .orderBy(F.xxhash64("paragraph"), "paragraph").limit(rule.plain_rows)
        .select(F.lit(0).alias("label"), "paragraph", (~back).alias("seen"), back.alias("back"))
    )
    # written once: both fits and the calibration read it
    rows = materialize(made.unionByName(plain).withColumn("label", F.col("label").cast("double")))
    logistic = LogisticRegression(
        featuresCol="features", labelCol="label", family="multinomial", maxIter=rule.iterations,
        regParam=rule.penalty, standardization=False, probabilityCol="p", rawPredictionCol="margin", predictionCol="guess",
    )
    stages = Pipeline(stages=[*_features(rule), logistic])
    first = LicenseModel(rule, stages.fit(rows.filter("seen")), labels, templates=_templates(names_kept_back(rule)))
    # the decisions that hang on the probability alone; at most the rows of the fit
    judged = _judged(first.pipeline.transform(rows.filter("back")), first).filter(
        (F.col("guess") > 1) & (F.col("likeness") >= rule.confirm) & ~F.col("identified")
    )
    kept = [(r["probability"], r["label"] == r["guess"]) for r in judged.select("probability", "label", "guess").collect()]
    return LicenseModel(rule, stages.fit(rows), labels, least_probability(kept, rule.precision), _templates())


def least_probability(kept: list[tuple[float, bool]], precision: float) -> float:
    """Smallest probability of the grid 0.30, 0.35 ... 0.95 from which on a share ``precision`` of (probability, right) is right.

    Where no value gives it, or nothing was decided, the largest is taken.
    """
    for least in [x / 100 for x in range(30, 96, 5)]:
        sure = [right for p, right in kept if p >= least]
        if sure and sum(sure) >= precision * len(sure):
            return least
    return 0.95


def _constant(value: list, schema: str) -> Column:
    """Fixed rows as one constant; thousands of literals would burden the driver with their plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _literal(spark: SparkSession, rows: list[tuple[int, str, bool, bool]]) -> DataFrame:
    names = ("label", "paragraph", "seen", "back")
    made = _constant([dict(zip(names, r)) for r in rows], "array<struct<label: int, paragraph: string, seen: boolean, back: boolean>>")
    return spark.range(0, 1, 1, 1).select(F.inline(made))


def _stated(words: Column, word: str) -> Column:
    """Whether ``word`` stands where the name of a licence does; anywhere else it confirms nothing."""
    before = r"(under|covered by|licen[sc]ed?|spdx-license-identifier|terms of)( the| an?)? "
    word = re.escape(word)
    return F.array_join(words, " ").rlike(rf"(^| )({before}{word}|{word} (licen[sc]e|applies to))( |$)")


def _likeness(guess: Column, grams: Column, templates: dict[str, list[list[str]]]) -> Column:
    """Largest share of a template's words and pairs of neighbouring words that stand in the paragraph.

    Templates of one plain word have no share; they count where they are stated.
    """
    parts = [
        {"family": f, "parts": sorted({*t, *[f"{a} {b}" for a, b in zip(t, t[1:])]})}
        for f, ts in templates.items() for t in ts if len(t) > 1 or not t[0].isalpha()
    ]
    fixed = _constant(parts, "array<struct<family: string, parts: array<string>>>")
    of_family = F.filter(fixed, lambda t: t["family"] == guess)
    shares = F.transform(of_family, lambda t: F.size(F.array_intersect(grams, t["parts"])) / F.size(t["parts"]))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def _judged(scored: DataFrame, model: LicenseModel) -> DataFrame:
    """``scored`` with guess_name, probability, likeness to the guess's templates, identified."""
    names = F.array(*[F.lit(x) for x in model.labels])
    guess, words = F.col("guess_name"), F.col("w1")
    stated, identified = F.lit(False), F.lit(False)
    for f, templates in model.templates.items():
        for t in templates:
            if len(t) == 1:
                here = (guess == f) & _stated(words, t[0])
                identified = identified | here
                stated = stated | here if t[0].isalpha() else stated
    named = scored.withColumns({
        "guess_name": F.element_at(names, F.col("guess").cast("int") + 1), "probability": F.array_max(vector_to_array("p")),
    })
    likeness = F.when(stated, 1.0).otherwise(_likeness(guess, F.col("grams"), model.templates))
    return named.withColumns({"likeness": likeness, "identified": identified})


def license_statements(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, place, family, probability, likeness, confirmed for each paragraph with a licence.

    A row without text has none. Rows that repeat a doc_id give rows of their own.
    A family whose probability is below the calibrated one, or that no template
    confirms, is reported as unknown; a guess that is less likely than none is not.
    Where an identifier of the family is stated, the probability need not be that high.
    """
    scored = model.pipeline.transform(paragraphs(docs)).filter(F.col("guess") > 0)
    named = _judged(scored.select("doc_id", "place", "w1", "grams", "guess", "p"), model)
    confirmed = F.col("likeness") >= model.rule.confirm
    sure = F.col("identified") | (F.col("probability") >= model.least)
    family = F.when(confirmed & sure, F.col("guess_name")).otherwise(UNKNOWN)
    return named.select("doc_id", "place", family.alias("family"), "probability", "likeness", confirmed.alias("confirmed"))


def license_scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_statements, families, statements for every row of ``docs``.

    Rows that repeat doc_id and text are one document and get the same answer, each in a
    row of its own. Rows that share doc_id with another text, or have none, are documents
    of their own. A null or empty text has no statements: 0 and nulls.
    """
    row = fresh(docs, "_row")
    numbered = with_rid(docs, row)
    found = license_statements(numbered.select(col(row).alias("doc_id"), col("text").alias("text")), model)
    one = F.struct("place", "family", F.round("probability", 6).alias("probability"), "confirmed")
    by_doc = found.groupBy(F.col("doc_id").alias("_doc")).agg(
        # no more than a document has lines; as sets, for the rows that repeat it
        F.sort_array(F.collect_set(one)).alias("statements"),
        F.array_sort(F.collect_set("family")).alias("families"),
    )
    ids = numbered.select(col("doc_id").alias("doc_id"), col(row).alias("_of"))
    joined = ids.join(by_doc, F.col("_of") == F.col("_doc"), "left")
    return joined.select(
        "doc_id", F.coalesce(F.size("statements"), F.lit(0)).alias("n_statements"), "families", "statements"
    )
