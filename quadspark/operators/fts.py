"""Full-text search over the literals of a property: match, BM25, and a stored index.

Without a stored index, a query is one condition on the token array of each
literal, so a search is one scan without a shuffle. A stored index is a table
(s, row_id, lang, token, pos) in files sorted by token, of which a query reads
those of its own words; ``refresh`` adds and takes away literals.

Bare words must all occur in one literal; ``word*`` is a prefix; ``"a b"`` a
phrase; ``-word`` must not occur; ``NEAR(a b, 5)`` has its words with at most so
many others between the first and the last; ``a OR b`` either side.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import tokens
from .closure import checkpointed

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


_TERM = r'-?NEAR\([^)]*\)|-?"[^"]*"|\S+'


def _sides(query: str) -> list[tuple[list[str], list[str]]]:
    """For each side of OR, the terms that must and those that must not occur."""
    if re.search(r"\w:|[()]", re.sub(r"NEAR\([^)]*\)", "", query)):
        raise ValueError("column filters and parentheses are not supported")
    out = []
    for side in re.split(r"\s+OR\s+", query.strip()):
        terms = re.findall(_TERM, side)
        want, avoid = [t for t in terms if t[0] != "-"], [t[1:] for t in terms if t[0] == "-"]
        if not want:
            raise ValueError("a query needs a word that must occur")
        out.append((want, avoid))
    return out


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _holds(own: Column, term: str) -> Column:
    """Whether a token array has the term."""
    if term.startswith("NEAR("):
        names, _, most = term[5:-1].partition(",")
        span = int(most or 10) + 2
        places = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)))
        return F.exists(places, lambda i: reduce(lambda a, b: a & b, [F.array_contains(F.slice(own, i, span), w) for w in _words(names)]))
    if term.startswith('"'):
        return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).contains(f" {' '.join(_words(term))} ")
    if term.endswith("*"):
        return F.exists(own, lambda t: t.startswith(term.lower().rstrip("*")))
    return F.array_contains(own, term.lower())


def matches(text: Column, query: str) -> Column:
    """Whether a literal's text satisfies the query."""
    own = tokens(text)
    both = lambda xs: reduce(lambda a, b: a & b, xs)
    sides = [both([_holds(own, t) for t in want] + [~_holds(own, t) for t in avoid]) for want, avoid in _sides(query)]
    return F.coalesce(reduce(lambda a, b: a | b, sides), F.lit(False))


def row_id() -> Column:
    """What a literal (s, lex, lang) is known by in an index."""
    return F.xxhash64("s", "lex", "lang")


def find(values: DataFrame, query: str, lang: str | None = None) -> DataFrame:
    """Rows of ``values`` (s, lex, lang) that match: one scan."""
    rows = values if lang is None else values.where(F.col("lang") == lang)
    return rows.where(matches(F.col("lex"), query))


def index(values: DataFrame) -> DataFrame:
    """(s, row_id, lang, token, pos): a row for each token of each literal."""
    rows = values.select("s", "lang", row_id().alias("row_id"), tokens(F.col("lex")).alias("t"))
    return rows.select("s", "row_id", "lang", F.posexplode("t").alias("pos", "token"))


class Stored:
    """An index kept in files sorted by token, so that a word reads little of it."""

    SHAPE = "s string, row_id bigint, lang string, token string, pos int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, values: DataFrame, path: str) -> Stored:
        """Index ``values`` (s, lex, lang) under ``path``, in place of what is there."""
        cls._write(index(values), f"{path}/tokens", "overwrite")
        out = cls(values.sparkSession, path)
        out._gone(values.sparkSession.createDataFrame([], "row_id bigint"), "overwrite")
        return out

    @staticmethod
    def _write(rows: DataFrame, path: str, mode: str) -> None:
        """Files are ranges of tokens, a frequent one over several, so that the files' bounds leave few to read for a word."""
        rows.repartitionByRange("token", "row_id").sortWithinPartitions("token", "row_id").write.mode(mode).parquet(path)

    def _gone(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).parquet(f"{self.path}/gone")

    def refresh(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Keep in step with changed literals (s, lex, lang): removed ones are marked, added ones get tokens; ``build`` cleans up."""
        if removed is not None:
            self._gone(removed.select(row_id().alias("row_id")).distinct(), "append")
        if added is not None:
            back = added.select(row_id().alias("row_id")).distinct()
            left = checkpointed(self.spark.read.schema("row_id bigint").parquet(f"{self.path}/gone").join(back, "row_id", "left_anti"))
            known = self.rows(every=True).select("row_id").distinct()
            self._write(index(added.withColumn("row_id", row_id()).join(known, "row_id", "left_anti").drop("row_id")), f"{self.path}/tokens", "append")
            self._gone(left, "overwrite")

    def rows(self, *words: str, every: bool = False) -> DataFrame:
        """Index rows of the words (``word*`` for a prefix), or all; without removed literals unless ``every``."""
        out = self.spark.read.schema(self.SHAPE).parquet(f"{self.path}/tokens")
        if words:
            out = out.where(reduce(lambda a, b: a | b, [self._is(w) for w in words]))
        if not every:
            out = out.join(self.spark.read.schema("row_id bigint").parquet(f"{self.path}/gone"), "row_id", "left_anti")
        return out.select("s", "row_id", "lang", "token", "pos")

    @staticmethod
    def _is(word: str) -> Column:
        return F.startswith("token", F.lit(word[:-1])) if word.endswith("*") else F.col("token") == word

    def match(self, query: str, lang: str | None = None) -> DataFrame:
        """(row_id, s) of the literals that match; only the query's words are read, and met by literal in one grouping."""
        sides = _sides(query)

        def words_of(term: str) -> list[str]:
            return _words(term[5:-1].partition(",")[0]) if term.startswith("NEAR(") else _words(term) if term.startswith('"') else [term.lower()]

        words = list(dict.fromkeys(w for want, avoid in sides for t in (*want, *avoid) for w in words_of(t)))
        rows = self.rows(*words)
        rows = rows if lang is None else rows.where(F.col("lang") == lang)
        places = {w: F.col(f"w{i}") for i, w in enumerate(words)}
        met = rows.groupBy("row_id", "s").agg(*(F.collect_list(F.when(self._is(w), F.col("pos"))).alias(f"w{i}") for i, w in enumerate(words)))

        def holds(term: str) -> Column:
            own = [places[w] for w in words_of(term)]
            if term.startswith("NEAR("):
                span = int(term[5:-1].partition(",")[2] or 10) + 1
                near = lambda x: reduce(lambda a, b: a & b, [F.exists(p, lambda y: (y >= x) & (y <= x + span)) for p in own])
                return F.exists(reduce(F.array_union, own), near)
            # Of a phrase, the places of each word less its place in the phrase have one in common.
            back = lambda p, i: F.transform(p, lambda x: x - F.lit(i))
            starts = [back(p, i) for i, p in enumerate(own)]
            return F.size(reduce(F.array_intersect, starts)) > 0

        both = lambda xs: reduce(lambda a, b: a & b, xs)
        test = reduce(lambda a, b: a | b, [both([holds(t) for t in want] + [~holds(t) for t in avoid]) for want, avoid in sides])
        return met.where(test).select("row_id", "s")


def bm25(values: DataFrame, query: str, distinct_rows: bool = False) -> DataFrame:
    """(s, bm25): for each subject its best literal's score, lower is better; literals must have all words.

    ``values`` (s, lex, lang) are read in two scans: one for the number of
    literals, their mean length and each word's document frequency, one for the
    scores, which are a row-wise expression.
    """
    words = [w.lower() for w in re.findall(r"\w+\*?", query)]
    rows = (values.select("s", "lex", "lang").distinct() if distinct_rows else values).select("s", tokens(F.col("lex")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda t: t.startswith(w[:-1]) if w.endswith("*") else t == w))
    own = rows.select("s", F.size("t").alias("l"), *(count(w).alias(f"f{i}") for i, w in enumerate(words)))
    stats = own.agg(F.count("*").alias("n"), F.sum("l").alias("total"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = max(math.log((stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)), LEAST_IDF)
        mean = (stats["total"] or 0) / max(1, stats["n"])
        score = score - F.lit(idf) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("l") / F.lit(mean or 1.0)))
    found = own.where(" AND ".join(f"f{i} > 0" for i in range(len(words))))
    return found.groupBy("s").agg(F.min(score).alias("bm25"))
