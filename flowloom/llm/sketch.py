"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the
sketch of a union is the union of the sketches, and shares of common hashes estimate
likeness and containment between texts of very unequal length. A short text keeps all
of its hashes; two sketches are compared at the smaller fraction of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions.text import let
from flowloom.llm.common import col, partitions

BITS = 48  # of the 64-bit hash
TOP = 1 << BITS


@dataclass(frozen=True)
class SketchRule:
    words: int = 5
    scale: int = 8  # one of so many hashes is kept
    short: int = 64  # a text of at most so many shingles keeps all

    def sketch(self, text: Column) -> Column:
        """Struct of ``all`` (whether every hash is kept) and sorted distinct ``kept`` hashes."""
        words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return let(words, self._of_words)

    def _of_words(self, w: Column) -> Column:
        k = self.words

        def shingle(i: Column) -> Column:
            return F.xxhash64(*[F.get(w, i + j) for j in range(k)])

        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), shingle)
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(
            F.array().cast("array<long>")
        )
        hashes = F.transform(
            F.when(F.size(w) >= k, many).otherwise(whole), lambda h: F.shiftrightunsigned(h, 64 - BITS)
        )
        return let(hashes, lambda h: F.struct(
            (F.size(h) <= self.short).alias("all"),
            F.array_sort(F.array_distinct(
                F.when(F.size(h) <= self.short, h).otherwise(F.filter(h, self._low))
            )).alias("kept"),
        ))

    def _low(self, h: Column) -> Column:
        return h < F.lit(TOP // self.scale)

    def fingerprint(self, sketch: Column) -> Column:
        """The sketch as text: a or s (all or scaled), then 13 hexadecimal digits for each hash."""
        digits = F.array_join(F.transform(sketch["kept"], lambda h: F.hex(h + F.lit(TOP))), "")
        return F.lower(F.concat(F.when(sketch["all"], "a").otherwise("s"), digits))

    def likeness(self, a: Column, b: Column) -> Column:
        """Estimated Jaccard similarity, 0 to 1; two texts without words are alike."""
        return self._compare(a, b, lambda x, y, both: both / (F.size(x) + F.size(y) - both))

    def containment(self, a: Column, b: Column) -> Column:
        """Estimated share of a's shingles that b has too."""
        return self._compare(a, b, lambda x, y, both: F.when(F.size(x) > 0, both / F.size(x)).otherwise(0.0))

    def _compare(self, a: Column, b: Column, share) -> Column:
        scaled = ~(a["all"] & b["all"])
        x = F.when(a["all"] & scaled, F.filter(a["kept"], self._low)).otherwise(a["kept"])
        y = F.when(b["all"] & scaled, F.filter(b["kept"], self._low)).otherwise(b["kept"])
        pair = F.struct(x.alias("x"), y.alias("y"))
        return let(pair, lambda p: F.when(
            (F.size(p["x"]) == 0) & (F.size(p["y"]) == 0), (a["kept"] == b["kept"]).cast("double")
        ).otherwise(share(p["x"], p["y"], F.size(F.array_intersect(p["x"], p["y"])))))

    def merged(self, a: Column, b: Column) -> Column:
        """Sketch of both texts together (shingles over the seam left out)."""
        whole = a["all"] & b["all"]
        joined = F.array_sort(F.array_union(a["kept"], b["kept"]))
        return F.struct(
            whole.alias("all"), F.when(whole, joined).otherwise(F.filter(joined, self._low)).alias("kept")
        )


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, *columns, next_*) where next is the row with the next doc_id, after the last the first.

    Rows with the same doc_id follow in the order of ``columns``; a null doc_id comes last.
    Rows are dealt out once, by ranges of doc_id whose borders are approximate quantiles;
    the first rows of a range also go to the range before it.
    """
    wanted = 2 * partitions(docs)
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("q")).first()["q"]
    borders = sorted({int(x) for x in found or []})
    place = F.size(F.filter(F.lit(borders) if borders else F.array().cast("array<long>"), lambda b: b <= F.col("doc_id")))
    blocked = docs.withColumn("_block", F.when(F.col("doc_id").isNull(), len(borders) + 1).otherwise(place))
    # one row for each range: as many as there are borders
    firsts = sorted(
        blocked.groupBy("_block").agg(F.min("doc_id").alias("first")).collect(), key=lambda r: r["_block"]
    )
    before = [(r["first"], firsts[k - 1]["_block"]) for k, r in enumerate(firsts)]
    one = [F.struct(F.lit(f).cast("long").alias("_first"), F.lit(b).cast("int").alias("_before")) for f, b in before]
    none = F.array().cast("array<struct<_first:bigint,_before:int>>")
    ahead = docs.sparkSession.range(1).select(F.inline(F.array(*one) if one else none))
    both = F.when(
        F.col("_before").isNotNull(),
        F.array(F.struct("_block", F.lit(False).alias("_extra")), F.struct(F.col("_before").alias("_block"), F.lit(True).alias("_extra"))),
    ).otherwise(F.array(F.struct("_block", F.lit(False).alias("_extra"))))
    dealt = (
        blocked.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
        .select("doc_id", *columns, F.explode(both).alias("_b"))
        .select("doc_id", *columns, "_b._block", "_b._extra")
    )
    order = Window.partitionBy("_block").orderBy("_extra", F.col("doc_id").asc_nulls_last(), *columns)
    nexts = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(nexts).filter(~F.col("_extra")).drop("_block", "_extra")


def document_fingerprints(docs: DataFrame, rule: SketchRule = SketchRule()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last quarter (in code points, rounded down) is
    replaced by as many of the first code points of the next document, or all it has.
    Null texts count as empty; an empty text has an empty sketch. A single row is its
    own next document.
    """
    text = F.coalesce(col("text").cast("string"), F.lit(""))
    base = docs.select(col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sketched = base.withColumn("sketch", rule.sketch(F.col("text")))
    paired = with_next(sketched, ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter)
    )
    cut = paired.select("doc_id", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    done = cut.select(
        "doc_id", "n_chars", "sketch", "next_sketch",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rule.sketch(F.col("edited")).alias("edited_sketch"),
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        rule.fingerprint(F.col("sketch")).alias("fingerprint"),
        rule.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        rule.likeness(F.col("sketch"), F.col("edited_sketch")).cast("double").alias("near_edited"),
        rule.likeness(F.col("sketch"), F.col("next_sketch")).cast("double").alias("near_next"),
    )
