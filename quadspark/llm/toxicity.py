"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the first four and five letters of longer words, and again
with a mark where one occurs twice, three or five times in the text. A bounded
sample of labelled rows of either class gives the examples; the terms are all
those whose chi-squared association with the label is significant for the number
of terms tried. Document frequencies are counted over all documents.

The examples stand in the order of their heaviest term, in blocks of BLOCK. The
inverted index keeps the postings of each (term, block) and the greatest weight
among them. A document adds these maxima up to an upper bound for each block and
reads the postings of the best blocks, then only those of blocks whose bound
reaches the k-th similarity found: the k nearest are exact, and the postings of
the other blocks are never read. The votes, weighted by squared similarity,
become a probability through a logistic curve fitted to the examples'
leave-one-out votes, weighted to the classes' shares of all training labels. The
nearest examples are returned as evidence.

The index is broadcast: its size is bounded by the number of examples and their
terms, not by the corpus. Documents are scored where they are read, without a
shuffle; a fit reads them twice, for the sample and for the document frequencies.

Defined results: a null text is an empty text; a text without a kept term has no
neighbours and gets the (smoothed) share of toxic labels among such examples;
ties in similarity go to the lesser doc_id; equal texts get equal scores; of the
rows of a labelled doc_id the least text is the example; a null doc_id has no label; with no
labels to learn from every score is 0; other columns change nothing, whatever
their names, and a column of the output's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, is_held_out, load, sample_rates, share

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 16
TIMES = (2, 3, 5)
_KNOWN_LIMIT = 300_000
RESULT = "score double, predicted int, n_neighbors int, evidence array<struct<doc_id:long,similarity:double,label:int>>"


def word_terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)]


def all_terms(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for t in word_terms(word):
            out[t] += n
    for t, n in list(out.items()):
        for m in TIMES:
            if n >= m:
                out[f"{t}*{m}"] = 1
    return out


class TermIds:
    """Kept terms of a text as ids and counts; words are looked up once while remembered."""

    def __init__(self, terms: list[str]):
        self.kept: dict[str, list[tuple[int, int]]] = {}  # base term -> (times, id)
        for i, t in enumerate(terms):
            base, _, times = t.partition("*")
            self.kept.setdefault(base, []).append((int(times or 1), i))
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, text: str | None) -> dict[int, int]:
        found: dict[str, int] = {}
        for word in _WORD.findall((text or "").lower()):
            bases = self.known.get(word)
            if bases is None:
                if len(self.known) >= _KNOWN_LIMIT:
                    self.known.clear()
                bases = self.known[word] = tuple(t for t in word_terms(word) if t in self.kept)
            for t in bases:
                found[t] = found.get(t, 0) + 1
        return {i: n if times == 1 else 1 for t, n in found.items() for times, i in self.kept[t] if n >= times}


@dataclass
class Index:
    """Postings by (term, block) with block maxima; ``curve`` is (intercept, slope, score without neighbours)."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    k: int
    examples: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # of the postings, by term and then example
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    begins: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int32))  # term, block -> its first posting
    maxima: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    blocks_met: int = 0
    blocks_read: int = 0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), np.int64)
        w = (1.0 + np.log(np.array([counts[i] for i in at.tolist()], np.float64))) * self.idf[at]
        norm = math.sqrt(float(w @ w))
        return at, w / norm if norm else w

    def _read(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray, sims: np.ndarray) -> None:
        """Add the postings of these terms in these blocks to ``sims``."""
        first = self.begins[at][:, blocks]
        n = (self.begins[at][:, blocks + 1] - first).ravel()
        places = np.repeat(first.ravel() - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        value = self.weights[places] * np.repeat(np.repeat(w, len(blocks)), n)
        sims += np.bincount(self.examples[places], value, len(sims))
        self.blocks_read += len(blocks)

    def nearest(self, counts: dict[int, int], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine, best first, and the cosines."""
        if not counts or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        at, w = self.vector(counts)
        bounds = w @ self.maxima[at]
        order = np.argsort(-bounds, kind="stable")[: int((bounds > 0).sum())]
        self.blocks_met += len(bounds)
        sims, least, done = np.zeros(len(self.ids)), 0.0, 0
        step = max(2, self.k // 4)
        while done < len(order) and bounds[order[done]] >= least * (1 - 1e-9):
            some = order[done : done + step]
            self._read(at, w, some[bounds[some] >= least * (1 - 1e-9)], sims)
            if skip >= 0:
                sims[skip] = 0.0
            least = float(np.partition(sims, -self.k)[-self.k]) if len(sims) > self.k else 0.0
            done, step = done + len(some), step * 2
        hit = np.flatnonzero(sims > 0)
        best = hit[np.lexsort((hit, self.ids[hit], -np.round(sims[hit], 12)))][: self.k]
        return best, sims[best]

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        w = sims * sims
        return float(w @ self.labels[best] / w.sum()) if len(best) else -1.0

    def score(self, vote: float) -> float:
        a, b, none = self.curve
        return none if vote < 0 else 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, a + b * vote))))


def build_index(terms: list[str], idf: np.ndarray, rows: list[tuple[int, int, dict[int, int]]], k: int) -> Index:
    """From (doc_id, label, counts by term id), in the order that the index keeps."""
    index = Index(terms, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), k)
    made = [index.vector(counts) for _, _, counts in rows]
    t = np.concatenate([np.empty(0, np.int64), *(at for at, _ in made)])
    e = np.repeat(np.arange(len(rows)), [len(at) for at, _ in made])
    w = np.concatenate([np.empty(0), *(w for _, w in made)])
    order = np.lexsort((e, t))
    t, index.examples, index.weights = t[order], e[order].astype(np.int32), w[order]
    blocks = max(1, -(-len(rows) // BLOCK))
    # The postings are in order of term * (blocks + 1) + block; the extra block of each term is empty and ends it.
    place = t * (blocks + 1) + index.examples // BLOCK
    index.begins = np.searchsorted(place, np.arange(len(terms) * (blocks + 1))).astype(np.int32).reshape(len(terms), blocks + 1)
    index.maxima = np.zeros((len(terms), blocks))
    np.maximum.at(index.maxima, (t, index.examples // BLOCK), index.weights)
    return index


def in_blocks(rows: list[tuple[int, int, dict[int, int]]], idf: np.ndarray) -> list[tuple[int, int, dict[int, int]]]:
    """Examples in the order of their heaviest terms, so that a block holds like ones and its maxima are close to its members."""
    heavy = lambda counts: sorted(counts, key=lambda i: (-(1.0 + math.log(counts[i])) * idf[i], i))[:3]
    return sorted(rows, key=lambda r: (heavy(r[2]), r[0], r[1]))


def calibrate(index: Index, rows: list[tuple[int, int, dict[int, int]]], shares: dict[int, float]) -> tuple[float, float, float]:
    """A logistic curve through the examples' leave-one-out votes, with the classes weighted to ``shares``."""
    votes = np.array([index.vote(*index.nearest(c, skip=e)) for e, (_, _, c) in enumerate(rows)])
    labels = index.labels
    n = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    weight = np.where(labels == 1, shares.get(1, 0.0) / n[1], shares.get(0, 0.0) / n[0]) * len(rows)
    alone = votes < 0
    total = float(weight[alone].sum())
    none = (float(weight[alone] @ labels[alone]) + shares.get(1, 0.0)) / (total + 1.0)
    x, y, w = votes[~alone], labels[~alone], weight[~alone]
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton's method, with a ridge that keeps separable votes finite
        p = 1.0 / (1.0 + np.exp(-(a + b * x)))
        g = np.array([(w * (p - y)).sum() + 0.05 * a, (w * (p - y) * x).sum() + 0.05 * b])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 0.05, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.05]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b), float(none)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", key: str = "doc_id", text: str = "text",
    examples: int = 1_500, least_count: int = 4, level: float = 0.01, k: int = 9,
) -> Index:
    """An index of about ``examples`` labelled rows of either class, chosen by a hash of ``key``.

    A doc_id with several labels counts as toxic where their mean is a half or more.
    """
    known = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    rates = sample_rates(counts.items(), examples)
    rate = F.when(F.col("label") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    chosen = F.broadcast(known.where(share(F.col("doc_id"), 31) < rate))  # about 2 * examples rows
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    least = F.min(F.coalesce("text", F.lit(""))).alias("text")  # one example for each doc_id, however many rows have it
    sample = checkpointed(texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(least))  # read three times below

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [all_terms(t) for t in batch["text"]]
            yield pd.DataFrame({"label": np.repeat(batch["label"].to_numpy(), [len(x) for x in both]), "term": [t for x in both for t in x]})

    per_term = sample.mapInPandas(explode, "label int, term string").groupBy("term").agg(
        F.sum(F.col("label")).cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    per_term = checkpointed(per_term)
    sizes = {r[0]: float(r[1]) for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0.0), sizes.get(0, 0.0)
    frequent = per_term.where(F.col("a") + F.col("b") >= least_count)
    tried = frequent.count()
    terms: list[str] = []
    if n1 and n0 and tried:
        c, d = F.lit(n1) - F.col("a"), F.lit(n0) - F.col("b")
        gap = F.greatest(F.abs(F.col("a") * d - F.col("b") * c) - (n1 + n0) / 2, F.lit(0.0))
        chi = F.try_divide(gap * gap * (n1 + n0), (F.col("a") + F.col("b")) * (c + d) * n1 * n0)  # null for a term that all examples have
        kept = frequent.withColumn("chi", F.coalesce(chi, F.lit(0.0))).where(F.col("chi") >= 2 * math.log(tried / level))
        terms = sorted(r[0] for r in kept.select("term").collect())  # of the examples' terms, those that tell

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, seen = TermIds(terms), np.zeros(len(terms), np.int64)
        rows = 0
        for batch in batches:
            rows += len(batch)
            for t in batch["text"]:
                found = ids.of(t)
                if found:
                    seen[list(found)] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(seen[at], rows)})

    frequency = texts.select("text").mapInPandas(count_terms, "term long, n long")
    found = {r[0]: r[1] for r in frequency.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([math.log(1.0 + found.get(-1, 0) / (1.0 + found.get(i, 0))) for i in range(len(terms))])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = TermIds(terms)
        for batch in batches:
            got = [ids.of(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [list(g) for g in got], "counts": [list(g.values()) for g in got]})

    made = sample.mapInPandas(vectors, "doc_id long, label int, terms array<int>, counts array<int>").collect()
    rows = in_blocks([(r[0], r[1], dict(zip(r[2], r[3], strict=True))) for r in made], idf)
    index = build_index(terms, idf, rows, k)
    if rows:
        index.curve = calibrate(index, rows, {y: n / total for y, n in counts.items()})
    return index


def score_toxicity(df: DataFrame, index: Index, text: str = "text", output: str = "toxicity", evidence: int = 3) -> DataFrame:
    """``df`` with the struct ``output``: score, predicted, n_neighbors and the nearest examples as evidence."""
    held = df.sparkSession.sparkContext.broadcast(index)
    made: list[TermIds] = []

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        index = held.value
        if not made:
            made.append(TermIds(index.terms))
        out = []
        for t in texts:
            best, sims = index.nearest(made[0].of(t))
            s = index.score(index.vote(best, sims))
            near = [{"doc_id": int(index.ids[e]), "similarity": float(x), "label": int(index.labels[e])} for e, x in zip(best[:evidence], sims[:evidence], strict=True)]
            out.append((s, int(s >= 0.5), len(best), near))
        return pd.DataFrame(out, columns=["score", "predicted", "n_neighbors", "evidence"])

    return df.withColumn(output, score(F.col(text)))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_held_out(F.col("doc_id"), 5, 0)
    index = fit(docs, load(spark, sf_dir, "labels"), ~held_out)
    near = F.array_join(F.transform("toxicity.evidence", lambda x: x["doc_id"].cast("string")), ",")
    return score_toxicity(docs, index).select("doc_id", held_out.alias("held_out"), "toxicity.score", "toxicity.predicted", near.alias("evidence"))
