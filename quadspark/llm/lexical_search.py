"""Ranked lexical search: a blocked sparse product of items by terms with terms by documents.

Terms are the maximal runs of letters, digits and non-ASCII characters, with A-Z
in lower case. The items are a query set: they are taken in parts of at most
``part_terms`` different terms, and a part's terms are all that a worker holds.
Each part reads the documents once and keeps them as blocks of ``docs_a_block``
documents (fewer where they are long): a block is a sparse matrix with a row for
each term (document, count), besides the documents' ids and lengths. Document frequencies, the number of
documents and their length are sums over the blocks. With them each count becomes
a 64-bit integer impact, and an item's row of the product is merged from the rows
of its terms (Gustavson) in a dense accumulator of a block's width. A task keeps
the best ``k`` of each item over its blocks; these meet in two levels of groups,
so that no group gathers more than PARTS_A_GROUP times ``k`` rows for an item.

Weights are floor(1000 ln((2N+2)/(2df+1))); a document's m is
100-50+((50 n N) div L); its score sums w ((10^9 tf) div (1000 tf + 20 m)) over
the terms of the item.

Defined results: a null or empty text has no term, as document or item, and ranks
nothing; documents with score 0 are not ranked; equal scores are ranked by
ascending doc_id, those without one last, and equal rows in any order, each
ranked; every row of the items is an item of its own, whatever its item_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import stored
from .common import load

PARTS_A_GROUP = 64
#: Every ASCII character but letters and digits becomes a space, A-Z lower case.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCK = "chunk int, docs array<long>, lengths array<long>, terms array<int>, starts array<int>, places array<int>, counts array<long>"
FOUND = "chunk int, item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def block_of(docs: list[tuple[int | None, np.ndarray, int]]) -> list:
    """A block of (doc_id, numbers of its terms, length) as docs, lengths and rows of (place, count) by term; places in order of doc_id, none last."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    ids = np.concatenate([d[1] for d in docs]).astype(np.int64)
    places = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d[1]) for d in docs])
    cells, counts = np.unique(ids * len(docs) + places, return_counts=True)
    terms, starts = np.unique(cells // len(docs), return_index=True)
    return [[d[0] for d in docs], [d[2] for d in docs], terms, np.append(starts, len(cells)), cells % len(docs), counts]


class Best:
    """The best ``k`` documents of each item so far: score descending, doc_id ascending, none last."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        had = self.held[item]
        if len(had[0]) >= self.k:
            keep = scores >= had[0][-1]
            if not keep.any():
                return
            scores, docs, none = scores[keep], docs[keep], none[keep]
        elif len(scores) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, docs, none = scores[keep], docs[keep], none[keep]
        scores, docs, none = (np.concatenate(x) for x in zip(had, (scores, docs, none), strict=True))
        order = np.lexsort((docs, none, -scores))[: self.k]
        self.held[item] = (scores[order], docs[order], none[order])


def blocks(docs: DataFrame, vocabulary, docs_a_block: int) -> DataFrame:
    """The documents as blocks, with the counts of the terms in ``vocabulary`` (a broadcast term -> number)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, held, size = vocabulary.value, TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            made = block_of(held)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(made, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *lists], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                words = terms_of(text)
                if words:
                    known = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                    held.append((doc_id, known[known >= 0], len(words)))
                    size += len(held[-1][1])
                if len(held) >= docs_a_block or size >= 512 * docs_a_block:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(build, BLOCK)


def product(made: DataFrame, items, weights, total: int, length: int, k: int) -> DataFrame:
    """The best ``k`` of each item over the blocks of a task. ``items``: lists of (term, multiplicity); ``weights``: by term; both broadcast."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight, best = items.value, weights.value, None
        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda name: batch.column(name)[r].values  # noqa: B023, E731
                docs, none = at("docs").fill_null(0).to_numpy(zero_copy_only=False), at("docs").is_null().to_numpy(zero_copy_only=False)
                lengths, terms, starts, places, tf = (at(c).to_numpy() for c in ("lengths", "terms", "starts", "places", "counts"))
                best = best or Best(len(rows), k)
                m = 50 + np.array([50 * int(n) * total // length for n in lengths], np.int64)
                impact = np.repeat(weight[terms], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
                row = np.full(len(weight), -1, np.int64)
                row[terms] = np.arange(len(terms))
                for item, (wanted, times) in enumerate(rows):
                    merged = np.zeros(len(docs), np.int64)
                    for i, n in zip(row[wanted].tolist(), times, strict=True):
                        if i >= 0:  # a term's places differ, so that the sum is one indexed addition
                            a, b = starts[i], starts[i + 1]
                            merged[places[a:b]] += impact[a:b] if n == 1 else n * impact[a:b]
                    some = np.flatnonzero(merged)
                    some = some[merged[some] > 0]
                    if len(some):
                        best.add(item, merged[some], docs[some], none[some])
        if best:
            chunk = TaskContext.get().partitionId()
            for item, (scores, docs, none) in enumerate(best.held):
                if len(scores):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(scores), chunk, np.int32)), pa.array(np.full(len(scores), item, np.int32)), pa.array(docs, mask=none), pa.array(scores)],
                        ["chunk", "item", "doc_id", "score"],
                    )

    return made.mapInArrow(rank, FOUND)


def top(df: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    multiplicity: bool = False, docs_a_block: int = 4_096, part_terms: int = 200_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item. With ``multiplicity`` a term counts as often as the item has it."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in parts_of(items.select(F.col(item_key).cast("long"), F.col(item_text).cast("string")), part_terms):
        number: dict[bytes, int] = {}
        rows = []
        for _, words in part:
            count: dict[int, int] = {}
            for w in words:
                t = number.setdefault(w, len(number))
                count[t] = count.get(t, 0) + 1
            rows.append((np.array(list(count), np.int64), [n if multiplicity else 1 for n in count.values()]))
        sc = spark.sparkContext
        made = stored(blocks(texts, sc.broadcast(number), docs_a_block), "search-blocks")
        total, length = made.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        if not total:
            continue
        holding = F.transform("terms", lambda t, i: F.struct(t.alias("t"), (F.element_at("starts", i + 2) - F.element_at("starts", i + 1)).alias("n")))
        weights = np.zeros(len(number), np.int64)
        for t, df in made.select(F.explode(holding).alias("x")).groupBy("x.t").agg(F.sum("x.n").alias("df")).collect():  # the terms of the part
            weights[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
        found = product(made, sc.broadcast(rows), sc.broadcast(weights), total, length, k)
        first = top(found.withColumn("group", F.floor(F.col("chunk") / PARTS_A_GROUP)), k, "item", "group").select("item", "doc_id", "score")
        ids = spark.createDataFrame([(i, x[0]) for i, x in enumerate(part)], "item int, item_id long")
        out = out.unionByName(top(first, k, "item").join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def parts_of(items: DataFrame, part_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items with their terms, in parts of about ``part_terms`` terms; one part on the driver at a time."""
    part: list[tuple[int | None, list[bytes]]] = []
    held = 0
    for item_id, text in items.toLocalIterator():
        words = terms_of(text)
        if not words:
            continue
        if part and held + len(words) > part_terms:
            yield part
            part, held = [], 0
        part.append((item_id, words))
        held += len(words)
    if part:
        yield part


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE_OP13 = """
WITH d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
  FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
