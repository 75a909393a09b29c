"""Quality by Bradley-Terry pairwise ranking.

From a bounded sample of labelled rows, pairs of a better (label 1) and a worse
(label 0) text are drawn; the weights maximise the logistic likelihood that the
better text wins, which depends on the difference of the two feature vectors
only. The features are read off the whole text: letter case, symbols, repetition
of words and lines, lengths, compressibility, and the shares of hashed words and
word pairs in HASHED bins each.

The cut between good and bad is a quantile of the scores of all training rows, at
the share of label 0 among their labels. Documents are scored where they are
read; only (doc_id, score) meets the labels.

Defined results: a null text is an empty text, and an empty one has features of
its own and gets a score; equal texts get equal scores; a doc_id with several
labels counts as good where their mean is a half or more, and of its rows the
least text is learned from; a null doc_id has no label; with labels of one class
only, or none, every score is 0.5; other columns change nothing, whatever their
names, and a column of the output's name is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, is_held_out, load, odd_constants, rolling, sample_rates, share

HASHED = 32
_PAIR = odd_constants(2, 61)
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 other mark
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:?'\"-" else 6


def features(text: str | None, seen: WordHashes) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w = max(1, len(data)), max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / n
    letters = max(1e-9, kinds[0] + kinds[1] + kinds[2])
    count = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    marked = sum(1 for x in count if x[-1:] in b"!*$%&#|@~^=+") / max(1, len(count))
    plain = [
        math.log1p(len(words)), float(sizes.mean()), float((sizes > 20).mean()), float((sizes == 1).mean()),
        kinds[2] / letters, kinds[3], kinds[5], kinds[6], len(count) / w, max(count.values(), default=0) / w, same,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))), marked,
        len(zlib.compress(data, 1)) / n, data.count(b"|") / w, float(len(words) == 0), min(1.0, 20 / w),
    ]
    hashes = seen.of(words)
    bins = lambda x: np.sqrt(np.bincount((x >> np.uint64(40)).astype(np.intp) % HASHED, minlength=HASHED) / max(1, len(x)))
    return plain + bins(hashes).tolist() + bins(rolling(hashes, 2, _PAIR)).tolist()


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expand(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.weights


def expand(z: np.ndarray) -> np.ndarray:
    """The counts also by their squares, as too little and too much may both be bad; the hashed bins as they are."""
    plain = z[:, : z.shape[1] - 2 * HASHED] if z.shape[1] > 2 * HASHED else z
    return np.concatenate([z, plain * plain / 6.0], axis=1)


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights that maximise the log-likelihood of 'better beats worse', by Newton's method with a ridge."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(d @ w, -50, 50)))
        g = d.T @ (p - 1.0) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rank(x: np.ndarray, labels: np.ndarray, pairs: int = 30_000, seed: int = 7) -> Ranking:
    """The ranking from a sample's features and labels, with a cut of 0."""
    if not len(labels) or labels.min() == labels.max():
        d = x.shape[1]
        return Ranking(np.zeros(d), np.ones(d), np.zeros(expand(np.zeros((1, d))).shape[1]), 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = expand(np.clip((x - mean) / scale, -6, 6))
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    return Ranking(mean, scale, bradley_terry(z[draw.choice(good, pairs)], z[draw.choice(bad, pairs)]), 0.0)


def labelled(labels: DataFrame, train: Column, label: str = "quality", key: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows to learn from, one for each doc_id."""
    kept = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull())
    return kept.groupBy(F.col(key).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))


def fit_weights(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 2_000) -> Ranking:
    """A ranking without its cut, from about ``sample_rows`` labelled rows of either class, chosen by a hash of ``key``."""
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    rates = sample_rates(counts.items(), sample_rows)
    rate = F.when(F.col("label") == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0))
    chosen = F.broadcast(known.where(share(F.col("doc_id"), 43) < rate))  # about 2 * sample_rows rows
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sample = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    @F.pandas_udf("array<double>")
    def read(each: pd.Series) -> pd.Series:
        seen = WordHashes()
        return pd.Series([features(t, seen) for t in each], dtype=object)

    rows = sorted((r[0], r[1], r[2]) for r in sample.select("doc_id", "label", read("text")).collect())  # numbers, not texts
    x = np.array([r[2] for r in rows]) if rows else np.empty((0, len(features("", WordHashes()))))
    return rank(x, np.array([y for _, y, _ in rows], np.int64))


def strength_of(ranking: Ranking, text: Column) -> Column:
    """The Bradley-Terry strength of a text."""
    made: list[WordHashes] = []

    @F.pandas_udf("double")
    def strength(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(WordHashes())
        return pd.Series(ranking.strength(np.array([features(t, made[0]) for t in texts])) if len(texts) else np.empty(0))

    return strength(text)


def cut_at(scored: DataFrame, known: DataFrame) -> float:
    """The quantile of the strengths (doc_id, strength) of all labelled rows at the share of label 0."""
    both = scored.select("doc_id", "strength").join(known, "doc_id")
    low, n = both.agg(F.sum(1 - F.col("label")), F.count("*")).first()
    if not n:
        return 0.0
    near = [max(0.0, (low - 1) / n), min(1.0, (low + 1) / n)]  # the last of the low share and the first above it
    a, b = both.agg(F.percentile_approx("strength", near, 100_000)).first()[0]
    return (a + b) / 2


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = 2_000) -> Ranking:
    """Weights from a bounded sample, and the cut from all rows with a label to learn from."""
    known = checkpointed(labelled(labels, train, label, key))
    ranking = fit_weights(docs, known, key, text, sample_rows)
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(known.select("doc_id"), "doc_id", "left_semi")
    return replace(ranking, cut=cut_at(checkpointed(own.select("doc_id", strength_of(ranking, F.col("text")).alias("strength"))), known))


def scored_by(ranking: Ranking, strength: Column) -> Column:
    """The struct of score in (0, 1) and predicted (1 from 0.5 on)."""
    score = 1 / (1 + F.exp(-F.least(F.greatest(strength - ranking.cut, F.lit(-50.0)), F.lit(50.0))))
    return F.struct(score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def score_quality(df: DataFrame, ranking: Ranking, text: str = "text", output: str = "quality") -> DataFrame:
    """``df`` with the struct ``output``: score and predicted."""
    return df.withColumn(output, scored_by(ranking, strength_of(ranking, F.col(text))))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = is_held_out(F.col("doc_id"), 3, 1)
    known = checkpointed(labelled(load(spark, sf_dir, "labels"), ~held_out))
    ranking = fit_weights(docs, known)
    scored = checkpointed(docs.select("doc_id", strength_of(ranking, F.col("text")).alias("strength")))  # texts are read once
    ranking = replace(ranking, cut=cut_at(scored, known))
    return scored.select("doc_id", held_out.alias("held_out"), scored_by(ranking, F.col("strength")).alias("q")).select("doc_id", "held_out", "q.score", "q.predicted")
