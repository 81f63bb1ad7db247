"""URL filters: a weighted vocabulary met by an Aho-Corasick automaton, and host rules.

The automaton finds all terms of the vocabulary in one pass over a url. A hit counts
only between boundaries (the ends of the url, or anything but a-z and 0-9). Strict
terms weigh as much as the limit, soft ones weigh 1; each distinct term counts once,
and a url whose weight reaches the limit is rejected. Host rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = (
    "casino", "porn", "xxx", "escort", "viagra", "cialis", "warez", "phishing", "malware", "spyware",
    "keygen", "hentai", "camgirls", "sportsbook",
)
SOFT = (
    "free", "win", "bet", "bets", "poker", "slots", "jackpot", "bonus", "cheap", "pills", "pharmacy", "ads",
    "track", "adult", "sex", "dating", "loan", "loans", "promo", "clicks", "replica", "crack", "torrent",
)


@dataclass(frozen=True)
class HostRule:
    """Holds for the host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    HostRule("allow", "com"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlVocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: int = 2  # distinct soft terms that reject a url

    def hits(self, url: Column) -> Column:
        """Struct of the distinct strict and soft terms of a url; none for null."""
        kinds = {t: 0 for t in self.soft} | {t: 1 for t in self.strict}
        built = []

        def counted(urls):
            if not built:  # once for each task
                made = ahocorasick.Automaton()
                for term in kinds:
                    made.add_word(term, term)
                made.make_automaton()
                built.append(made)
            automaton, strict, soft = built[0], [], []
            for url in urls.to_pylist():
                found = set()
                if url:
                    n = len(url)
                    for end, term in automaton.iter(url):
                        start = end - len(term) + 1
                        if (start == 0 or not _word(url[start - 1])) and (end + 1 == n or not _word(url[end + 1])):
                            found.add(term)
                k = sum(kinds[t] for t in found)
                strict.append(k)
                soft.append(len(found) - k)
            return pa.StructArray.from_arrays([pa.array(strict, pa.int32()), pa.array(soft, pa.int32())], ["strict", "soft"])

        counted.__annotations__ = {"urls": pa.Array, "return": pa.Array}
        lowered = F.translate(url, UPPER, LOWER)
        return F.arrow_udf(counted, "strict int, soft int")(lowered)


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(
    pages: DataFrame, vocabulary: UrlVocabulary = UrlVocabulary(), rules: tuple[HostRule, ...] = RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row.

    The longest rule that fits decides, else the vocabulary. A null url, or one
    without ``://``, has an empty host and path, so no rule fits; a null url has no
    hits and is allowed. Repeated rows are judged each.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(col("page_id").alias("page_id"), col("url").cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path"), vocabulary.hits(F.col("url")).alias("hits")
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.verdict == "block")):
        fits = (F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))
        fits &= F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    weight = F.col("hits.strict") * vocabulary.limit + F.col("hits.soft")
    method = F.when(weight >= vocabulary.limit, "block").otherwise("allow")
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"),
    )


def filter_sql(vocabulary: UrlVocabulary = UrlVocabulary(), rules: tuple[HostRule, ...] = RULES) -> str:
    """The same judgement as SQL, term by term."""

    def count(terms):
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INTEGER" for t in terms)

    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{}}'"
        for r in sorted(rules, key=lambda r: (-len(r.host), -len(r.path)))
    )
    ordered = sorted(rules, key=lambda r: (-len(r.host), -len(r.path)))
    names = fits.format(*[r.name for r in ordered])
    verdicts = fits.format(*[r.verdict for r in ordered])
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS u,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    ({count(vocabulary.strict)})::INTEGER AS strict_hits, ({count(vocabulary.soft)})::INTEGER AS soft_hits
  FROM cut
)
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {verdicts} WHEN strict_hits * {vocabulary.limit} + soft_hits >= {vocabulary.limit} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM parts
"""
