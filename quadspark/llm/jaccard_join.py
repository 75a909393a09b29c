"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each document becomes a set of ``width``-word shingles. Documents of one set
   form a class, named by a hash of the set; copies go no further.
2. MinHash values in bands: classes that share a band are candidates. Classes in
   a band's bucket are dealt into tiles of two chunks each, so that a bucket of
   any size is spread over tasks and no pair is ever a row. The rows dealt, and
   then the bytes of the sets, give the number of units that tiles are put in.
3. In a tile, pairs are compared by their MinHash values step by step. A pair
   leaves when the posterior probability (uniform prior) that its similarity
   reaches the threshold falls under ``tolerance``. A pair belongs to the first
   band in which it agrees, so it is met once.
4. Classes with a surviving pair bring their shingle sets to the tile, where the
   pairs are verified exactly. A tile returns, for each class, how many documents
   it links to and one edge to the least class of its part: a spanning forest
   instead of all pairs. Classes get their least doc_id at the end.

Defined results: a text of fewer words than ``width`` is one shingle; null texts
and those without a word are in no group, and the query gives each a class of its own; repeated rows are copies; a repeated
doc_id is one document for each row; rows without a doc_id are linked and counted
like others, and a class of such rows only has no exact_id, or no class_id; ids
are whole numbers, and one of another type must cast to long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import components
from .common import WordHashes, blocks_for, checkpointed, load, mix64, odd_constants, shingle_set, split_words

BANDS, ROWS, STEP = 20, 4, 16
CHUNK = 256
PAIRS_AT_ONCE = 40_000
ROWS_A_UNIT, BYTES_A_UNIT = 2_000, 1 << 20
_MULTIPLIERS = odd_constants(BANDS * ROWS, 21)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of 32 bits."""
    out = np.full(len(_MULTIPLIERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2_000):
        np.minimum(out, mix64(shingles[None, at : at + 2_000] * _MULTIPLIERS[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """After each number of compared values, the fewest matches with P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(4_000) + 0.5) / 4_000
    above, out = grid >= threshold, []
    for n in steps:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[above].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return out


def _surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Indices of the pairs that meet first in their own band and are not pruned."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    agrees = np.full(len(a), BANDS, np.int32)  # the first band that agrees
    for step, least in enumerate(fewest):
        cut = slice(step * STEP, (step + 1) * STEP)
        equal = sig[a[alive], cut] == sig[b[alive], cut]
        matches[alive] += equal.sum(axis=1, dtype=np.int32)
        whole = equal.reshape(len(alive), STEP // ROWS, ROWS).all(axis=2)
        found = np.where(whole.any(axis=1), step * (STEP // ROWS) + whole.argmax(axis=1), BANDS)
        agrees[alive] = np.minimum(agrees[alive], found)
        later = (step + 1) * (STEP // ROWS)
        alive = alive[(matches[alive] >= least) & ((agrees[alive] == band[alive]) | ((agrees[alive] == BANDS) & (band[alive] >= later)))]
    return alive


def _tile_pairs(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row indices of all pairs within the unit's tiles, some at a time, and their bands."""
    keys = rows[["bucket", "tile"]].to_numpy(np.int64)
    sides, bands = rows["side"].to_numpy(), rows["band"].to_numpy()
    order = np.lexsort((sides, keys[:, 1], keys[:, 0]))
    change = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(axis=1)) + 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for tile in np.split(order, change):
        side = sides[tile]
        if side[-1] == 0:
            one, two = np.triu_indices(len(tile), 1)
            pair = tile[one], tile[two]
        else:
            left, right = tile[side == 0], tile[side == 1]
            pair = np.repeat(left, len(right)), np.tile(right, len(left))
        held.append(pair)
        count += len(pair[0])
        if count >= PAIRS_AT_ONCE:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            yield a, b, bands[a]
            held, count = [], 0
    if count:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        yield a, b, bands[a]


def _signatures(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), BANDS * ROWS)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


class _Forest(dict):
    def root(self, x: bytes) -> bytes:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def union(self, x: bytes, y: bytes) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def _named(df: DataFrame, text: str, key: str) -> DataFrame:
    """(row, has_id, text): a row is found again by its doc_id, or by the hash of its text where it has none."""
    own = F.col(key).cast("long")
    rows = df.select(own.alias("own"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.select(F.coalesce("own", F.xxhash64("text")).alias("row"), F.col("own").isNotNull().alias("has_id"), "text")


def shingled(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """doc_id, row, has_id, hash of the shingle set, size of the set and its signature, for texts with words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in batches:
            out = []
            for row, has_id, value in zip(batch["row"], batch["has_id"], batch["text"], strict=True):
                s = shingle_set(seen.of(split_words(value)), width)
                if len(s):
                    out.append((row, has_id, xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s).tobytes()))
            yield pd.DataFrame(out, columns=["row", "has_id", "class", "n_shingles", "sig"])

    made = _named(df, text, key).mapInPandas(make, "row long, has_id boolean, class binary, n_shingles int, sig binary")
    return made.select(F.when(F.col("has_id"), F.col("row")).alias("doc_id"), "*")


def jaccard_join(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6
) -> DataFrame:
    """One row for each document with a word: doc_id, exact_id, class_id, n_links.

    ``exact_id`` is the least doc_id with the same shingle set, ``class_id`` that
    of the connected near-duplicate class, ``n_links`` the number of other
    documents with a similarity of ``threshold`` or more.
    """
    docs = checkpointed(shingled(df, text, key, width))
    # The row that a class's text is read from: of least doc_id, or of least hash where no row has one.
    first = F.min(F.struct((~F.col("has_id")).alias("no_id"), "row")).alias("first")
    classes = checkpointed(docs.groupBy("class").agg(first, F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))
    named = classes.withColumn("id", F.xxhash64("class"))
    fewest = least_matches(threshold, tolerance, [STEP * (i + 1) for i in range(BANDS * ROWS // STEP)])

    size = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sig", i * size + 1, size)).alias("bucket")))
    members = named.select("class", "id", F.explode(keys).alias("at")).select("class", "id", "at.*")
    buckets = checkpointed(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    unit = lambda size, per_unit: F.pmod(F.xxhash64("bucket", "tile"), F.lit(blocks_for(size, per_unit))).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit(9)), chunks).cast("int")
    # A member of chunk c goes to the tiles (c, c), (c, d) for later d and (d, c) for earlier d.
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda d: F.struct((F.least("chunk", d).cast("long") * F.col("chunks") + F.greatest("chunk", d)).alias("tile"), (d < F.col("chunk")).cast("int").alias("side")),
    )
    dealt = (
        members.join(buckets, "bucket")
        .select("class", "id", "band", "bucket", chunks.alias("chunks"), chunk.alias("chunk"))
        .select("class", "id", "band", "bucket", F.explode(tiles).alias("at"))
        .select("class", "id", "band", "bucket", "at.*")
        .withColumn("unit", unit(buckets.agg(F.sum(F.col("n") * chunks)).first()[0] or 0, ROWS_A_UNIT))
    )
    with_sig = dealt.join(named.select("class", "sig", "copies", "n_shingles"), "class")

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        sig, keep = _signatures(rows), np.zeros(len(rows), bool)
        for a, b, band in _tile_pairs(rows):
            alive = _surviving(sig, a, b, band, fewest)
            keep[a[alive]] = True
            keep[b[alive]] = True
        return rows.loc[keep, ["class", "id", "band", "bucket", "tile", "side", "unit", "sig", "copies", "n_shingles"]]

    shape = "class binary, id long, band int, bucket long, tile long, side int, unit int, sig binary, copies long, n_shingles int"
    survivors = checkpointed(with_sig.groupBy("unit").applyInPandas(candidates, shape))
    size_of_sets = survivors.agg(F.sum(F.col("n_shingles").cast("long") * 8 + F.lit(BANDS * ROWS * 4))).first()[0] or 0

    wanted = classes.join(survivors.select("class").distinct(), "class", "left_semi").select("first.row", (~F.col("first.no_id")).alias("has_id")).distinct()
    texts = _named(df, text, key).join(wanted, ["row", "has_id"], "left_semi").select("text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for batch in batches:
            made = [shingle_set(seen.of(split_words(t)), width).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"class": [xxhash.xxh3_128_digest(x) for x in made], "shingles": made})

    full = survivors.withColumn("unit", unit(size_of_sets, BYTES_A_UNIT)).join(texts.mapInPandas(sets, "class binary, shingles binary").dropDuplicates(["class"]), "class")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        sig = _signatures(rows)
        shingles = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        names, copies = rows["class"].tolist(), rows["copies"].to_numpy(np.int64)
        forest, links = _Forest(), dict.fromkeys(names, 0)
        for a, b, band in _tile_pairs(rows):
            alive = _surviving(sig, a, b, band, fewest)
            for i, j in zip(a[alive].tolist(), b[alive].tolist(), strict=True):
                if similarity(shingles[i], shingles[j]) >= threshold:
                    links[names[i]] += int(copies[j])
                    links[names[j]] += int(copies[i])
                    forest.union(names[i], names[j])
        return pd.DataFrame([(c, n, forest.root(c)) for c, n in links.items() if n], columns=["class", "links", "root"])

    linked = checkpointed(full.groupBy("unit").applyInPandas(verify, "class binary, links long, root binary"))
    parts = checkpointed(components(linked.select(F.col("class").alias("s"), F.col("root").alias("o"))).select(F.col("node").alias("class"), "component"))
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    own = F.when(~F.col("first.no_id"), F.col("first.row"))
    ids = classes.select("class", own.alias("exact_id"), "copies")
    least = ids.join(parts, "class").groupBy("component").agg(F.min("exact_id").alias("class_id"))
    near = parts.join(least, "component").join(links, "class").select("class", F.lit(True).alias("near"), "class_id", "links")
    by_class = ids.join(near, "class", "left").select(
        "class", "exact_id", F.when(F.col("near"), F.col("class_id")).otherwise(F.col("exact_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return docs.select("doc_id", "class").join(by_class, "class").select("doc_id", "exact_id", "class_id", "n_links")


def with_wordless(classes: DataFrame, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``classes`` and a row for each document of ``df`` without a word: a class of its own, without links."""
    own = F.col(key).cast("long")
    wordless = df.where(~F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return classes.unionByName(wordless.select(own.alias("doc_id"), own.alias("exact_id"), own.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row for each document."""
    docs = load(spark, sf_dir, "documents")
    return with_wordless(jaccard_join(docs), docs)
