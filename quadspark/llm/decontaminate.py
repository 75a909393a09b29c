"""Benchmark decontamination by SimHash windows of item size.

Each benchmark item gives 64-bit SimHashes of windows of its own words: of about
its whole length (the longest length of a geometric scale that fits, so five
sixths or more of it) and of about half of it, or of the shortest run that holds
half of its weight where that is shorter. An edit that is spread over a copy
moves few bits of the whole window; one that is in one place leaves a half as it
was. A document gives, for each length in use, the SimHashes of its windows at a
stride of a sixth of it (at every word up to 11), from running sums of bits;
an item gives as many windows next to each other, so no alignment is left out.

Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // BLOCKS`` bits of one of BLOCKS equal blocks. The index holds every
stored block under all values so near, so one look-up for each block finds all
fingerprints within the radius.

Around each find the exact similarity decides: the share of an item's five-word
shingles, weighted by rarity over the whole benchmark, in a stretch of at most
5/4 of the item's words; ``least`` or more is a match. The radius was chosen by
recall against brute force (see the README).

The index is broadcast, ``part_words`` words of items at a time: a larger
benchmark makes more passes, with a checkpoint between them, instead of a larger
broadcast. Weights are those of the whole benchmark whatever the parts.
Documents are never shuffled.

Defined results: words are split at ASCII white space and compared without ASCII
marks at their ends and with ASCII letters in lower case; null or empty texts and
items without a word match nothing; an item shorter than five words is one
shingle; equal items are separate items, and so are those without an item_id,
which match with a null one; rows of documents are independent, so ties, repeated
rows, null ids and other columns change nothing, and a column of the output's
name is replaced; each place of an item in a document is one match, by (start,
item_id), from where the item's first word would be to where its last would be;
of overlapping places of one item the most similar stays; ``distance`` is the
least of the windows that led to the match.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, load, odd_constants, rolling, split_words

WIDTH, BLOCKS = 5, 4
SLACK = 1e-9  # for rounding in sums of weights
SLICE = 12_000  # words at a time: their running sums stay in the cache, and fit 16 bits
MATCH = "array<struct<item_id:long,start:int,end:int,similarity:double,distance:int>>"
Match = tuple  # (item_id, start, end, similarity, distance)
_SHINGLE = odd_constants(WIDTH, 5)
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


class PlainHashes(WordHashes):
    """Hashes of words with ASCII letters in lower case, without ASCII marks at their ends."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word.lower().strip(_MARKS) or word)
        if len(self) >= 400_000:
            self.clear()
        self[word] = value
        return value


def window_length(words: int, every: int = 1) -> int:
    """The longest length within ``words`` of the scale 1, 2, ... 8, 9, 10, 12, 14, 16, 19, ..., or of each second one from 1 on.

    Each is at most 6/5 of the one before, and one more.
    """
    size = best = 1
    n = 0
    while (size := max(size + 1, size * 6 // 5)) <= words:
        n += 1
        best = size if n % every == 0 else best
    return best


def _shingles(hashes: np.ndarray) -> np.ndarray:
    return rolling(hashes, min(WIDTH, len(hashes)), _SHINGLE)


def running_bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int16 if len(hashes) < 32_000 else np.int32)
    np.cumsum(bits, axis=0, out=out[1:], dtype=out.dtype)
    return out


def stride(length: int) -> int:
    """Documents take a window at every so many words; items, at that many places in a row, so that all alignments occur."""
    return max(1, length // 6)


def simhashes(sums: np.ndarray, length: int, step: int = 1) -> np.ndarray:
    """Fingerprints of the windows of ``length`` words at every ``step``-th place, from running sums of bits."""
    bits = (sums[length::step] - sums[: len(sums) - length : step]) > length // 2
    return np.packbits(bits.reshape(-1)).view(np.uint64)


class MultiIndex:
    """All stored fingerprints within ``radius`` bits of a query, through BLOCKS blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        width = 64 // BLOCKS
        near = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]
        masks = np.array(near, np.int64)
        self.blocks = []
        for value in self._cut(prints).T:
            spread = (value.astype(np.int64)[:, None] ^ masks).ravel()
            order = np.argsort(spread, kind="stable")
            begins = np.searchsorted(spread[order], np.arange((1 << width) + 1))
            self.blocks.append(((order // len(masks)).astype(np.int32), begins.astype(np.int32), np.diff(begins) > 0))

    @staticmethod
    def _cut(prints: np.ndarray) -> np.ndarray:
        return prints.view(np.uint16).reshape(-1, BLOCKS)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of queries and stored prints, and distances, each pair once."""
        found = [np.empty((3, 0), np.int64)]
        values = self._cut(queries).astype(np.intp)
        for k, (owner, begins, used) in enumerate(self.blocks):
            hit = np.flatnonzero(used.take(values[:, k]))
            for at in range(0, len(hit), 50_000):
                some = hit[at : at + 50_000]
                value = values[some, k]
                first = begins.take(value)
                n = begins.take(value + 1) - first
                q = np.repeat(some, n)
                p = owner.take(np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(q)))
                d = np.bitwise_count(queries.take(q) ^ self.prints.take(p))
                close = np.flatnonzero(d <= self.radius)
                if len(close):
                    found.append(np.stack([q[close], p[close], d[close].astype(np.int64)]))
        q, p, d = np.concatenate(found, axis=1)
        _, once = np.unique(q * max(1, len(self.prints)) + p, return_index=True)
        return q[once], p[once], d[once]


class Shingles:
    """An item's distinct shingles, their numbers and weights, and the offsets at which each is first and last."""

    def __init__(self, values: np.ndarray, weight: dict[int, float]):
        self.values, self.first, self.number = np.unique(values, return_index=True, return_counts=True)
        self.last = len(values) - 1 - np.unique(values[::-1], return_index=True)[1]
        self.weight = np.array([weight[x] for x in self.values.tolist()])
        self.total = float((self.weight * self.number).sum())
        running = np.concatenate([[0.0], np.cumsum([weight[x] for x in values.tolist()])])
        ends = np.searchsorted(running, running[:-1] + self.total / 2 - SLACK)
        #: The fewest shingles in a row that hold half of the weight.
        self.core = int((ends - np.arange(len(values)))[ends < len(running)].min())


@dataclass
class Items:
    """A part of the benchmark, ready to look up."""

    ids: list[int | None]
    shingles: list[Shingles]
    lengths: list[int]
    classes: dict[int, tuple[MultiIndex, np.ndarray]]  # window length -> index, and the item of each print

    def reach(self, item: int) -> int:
        return self.lengths[item] + self.lengths[item] // 4


def item_hashes(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, np.ndarray]]:
    """(item_id, word hashes) of the items that have a word."""
    seen = PlainHashes()
    return [(item_id, seen.of(words)) for item_id, text in rows if (words := split_words(text))]


def build_items(rows: list[tuple[int | None, str | None]], radius: int, shared: dict[int, int] | None = None, total: int | None = None) -> Items:
    """``shared`` has the number of items of each shingle that is in several of the ``total`` items; by default these are ``rows``."""
    kept = item_hashes(rows)
    values = [_shingles(h) for _, h in kept]
    if shared is None:
        shared, total = Counter(x for s in values for x in set(s.tolist())), len(kept)
    shingles = []
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, (s, (_, h)) in enumerate(zip(values, kept, strict=True)):
        shingles.append(Shingles(s, {x: math.log(1.0 + total / shared.get(x, 1)) for x in set(s.tolist())}))
        n = len(h)
        half = min(n // 2, shingles[i].core + WIDTH - 1)
        sums = running_bits(h)
        for w in {window_length(n), window_length(half, 2) if half >= WIDTH else window_length(n)}:
            offsets = np.unique(np.append(np.arange(0, n - w + 1, max(1, w // 4)), n - w)[:, None] + np.arange(stride(w)))
            offsets = offsets[offsets <= n - w]
            by_length.setdefault(w, []).append((simhashes(sums, w)[offsets], i))
    classes = {}
    for w, each in by_length.items():
        classes[w] = MultiIndex(np.concatenate([p for p, _ in each]), radius), np.concatenate([np.full(len(p), i) for p, i in each])
    return Items([i for i, _ in kept], shingles, [len(h) for _, h in kept], classes)


def places(items: Items, item: int, hashes: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """(start, end, share) of stretches of ``hashes`` that hold ``least`` or more of the item's weight, with multiplicity.

    Of the stretches from one shingle on, the shortest of the greatest share.
    """
    own, length, reach = items.shingles[item], items.lengths[item], items.reach(item)
    width = min(WIDTH, length)
    found = rolling(hashes, width, _SHINGLE)
    known = np.minimum(np.searchsorted(own.values, found), len(own.values) - 1)
    hit = np.flatnonzero(own.values[known] == found)
    bound = (least - SLACK) * own.total
    if own.weight[known[hit]].sum() < bound:
        return []
    pos, what, number, weight = hit.tolist(), known[hit].tolist(), own.number.tolist(), own.weight.tolist()
    have, got, end, out = [0] * len(number), 0.0, 0, []
    for begin, x in enumerate(what):
        while end < len(pos) and pos[end] + width - pos[begin] <= reach:
            y = what[end]
            have[y] += 1
            got += weight[y] if have[y] <= number[y] else 0.0
            end += 1
        if got >= bound and have[x] <= number[x]:
            share = float((own.weight * np.minimum(own.number, have)).sum()) / own.total
            last, spare = end - 1, Counter()
            while have[what[last]] - spare[what[last]] > number[what[last]]:
                spare[what[last]] += 1
                last -= 1
            out.append((pos[begin] - int(own.first[x]), pos[last] + length - int(own.last[what[last]]), share))
        got -= weight[x] if have[x] <= number[x] else 0.0
        have[x] -= 1
    return out


def find_items(texts: list[str | None], items: Items, seen: PlainHashes, least: float) -> list[list[Match]]:
    """For each text its matches."""
    out: list[list[Match]] = []
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append(split_words(text))
        size += len(held[-1])
        if size >= SLICE:  # so that only a few documents' words are in memory at once
            out += _find(held, items, seen, least)
            held, size = [], 0
    return out + _find(held, items, seen, least)


def near_windows(hashes: np.ndarray, left: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, items and distances of all windows within the radius; ``left`` counts the words to each document's end."""
    found = [np.empty((3, 0), np.int64)]
    longest = max(items.classes)
    for a in range(0, len(hashes), SLICE):
        b = min(len(hashes), a + SLICE)
        sums = running_bits(hashes[a : b + longest - 1])
        for w, (index, owner) in items.classes.items():
            if len(sums) <= w:
                continue
            q, p, d = index.within(simhashes(sums[: b - a + w], w, stride(w)))
            at = a + q * stride(w)
            inside = left[at] >= w
            found.append(np.stack([at, owner[p], d])[:, inside])
    return tuple(np.concatenate(found, axis=1))


def _find(each: list[list[bytes]], items: Items, seen: PlainHashes, least: float) -> list[list[Match]]:
    out: list[list[Match]] = [[] for _ in each]
    lengths = np.array([len(w) for w in each], np.int64)
    if not items.classes or not lengths.sum():
        return out
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes = np.concatenate([seen.of(w) for w in each])
    doc = np.repeat(np.arange(len(each)), lengths)
    at, item, distance = near_windows(hashes, starts[doc + 1] - np.arange(len(hashes)), items)
    if not len(at):
        return out
    order = np.lexsort((at, item, doc[at]))
    at, item, distance = at[order], item[order], distance[order]
    reach = np.array(items.lengths)[item] * 5 // 4
    parted = (np.diff(item) != 0) | (np.diff(doc[at]) != 0) | (np.diff(at) > 2 * reach[1:])
    cuts = [0, *(np.flatnonzero(parted) + 1).tolist(), len(at)]
    met: dict[int, dict[tuple[bool, int], list[Match]]] = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        i, which, far = int(doc[at[a]]), int(item[a]), int(reach[a])
        begin, end = max(int(starts[i]), int(at[a]) - far), min(int(starts[i + 1]), int(at[b - 1]) + far)
        first, n, name = begin - int(starts[i]), int(lengths[i]), items.ids[which]
        for s, e, share in places(items, which, hashes[begin:end], least):
            s, e = max(0, first + s), min(n, first + e)
            near = distance[a:b][(at[a:b] - starts[i] < e) & (at[a:b] - starts[i] + far > s)]
            mine = met.setdefault(i, {}).setdefault((False, which) if name is None else (True, name), [])
            mine.append((name, s, e, share, int(near.min()) if len(near) else None))
    for i, named in met.items():
        out[i] = sorted((m for mine in named.values() for m in apart(mine)), key=lambda m: (m[1], m[0] is None, m[0] or 0, m[2], m[3]))
    return out


def apart(matches: list[Match]) -> list[Match]:
    """Of one item's matches that overlap, the one of greatest similarity, then least distance, then first."""
    kept: list[Match] = []
    spans: list[tuple[int, int]] = []
    for m in sorted(matches, key=lambda x: (-x[3], 65 if x[4] is None else x[4], x[1])):
        at = bisect_left(spans, (m[1], m[2]))
        if (at == len(spans) or m[2] <= spans[at][0]) and (at == 0 or spans[at - 1][1] <= m[1]):
            spans.insert(at, (m[1], m[2]))
            kept.append(m)
    return kept


def shared_shingles(rows: DataFrame) -> DataFrame:
    """(shingle, n): the shingles that several rows of (item_id, text, part) have, and (null, number of items)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(_shingles(h)).view(np.int64) for _, h in item_hashes([(None, t) for t in batch["text"]])]
            yield pd.DataFrame({"shingle": pd.array([x for s in sets for x in (*s.tolist(), None)], "Int64")})

    counted = rows.select("text").mapInPandas(each, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    return counted.where("n > 1 OR shingle IS NULL")


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    radius: int = 7, least: float = 0.8, part_words: int = 400_000, output: str = "matches",
) -> DataFrame:
    """``df`` with ``output``: array of (item_id, start, end, similarity, distance), word positions, end exclusive."""
    rows = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    words = rows.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0
    parts = max(1, math.ceil(words / part_words))
    counts = shared_shingles(rows) if parts == 1 else checkpointed(shared_shingles(rows))
    spark = df.sparkSession
    out = df.withColumn(output, F.array().cast(MATCH))
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about part_words words
        own = {x for _, h in item_hashes([tuple(r) for r in mine]) for x in _shingles(h).view(np.int64).tolist()}
        wanted = counts
        if parts > 1:  # the frequencies of this part's shingles, no others
            wanted = counts.join(F.broadcast(spark.createDataFrame([(x,) for x in own], "shingle long")), "shingle", "left_semi").unionByName(counts.where("shingle IS NULL"))
        shared = {r[0] if r[0] is None else r[0] % (1 << 64): r[1] for r in wanted.collect()}
        total = shared.pop(None, 0)
        held = spark.sparkContext.broadcast(build_items(sorted(((r[0], r[1] or "") for r in mine), key=lambda x: (x[0] is None, x[0] or 0, x[1])), radius, shared, total))
        out = out.withColumn(output, F.concat(output, _finder(held, least)(F.col(text))))
        if part < parts - 1:
            out = checkpointed(out)  # a pass of its own, so that a worker holds one part at a time
            held.unpersist()
    key = lambda m: F.struct(m["start"], m["item_id"].isNull(), F.coalesce(m["item_id"], F.lit(0)), m["end"], m["similarity"])
    order = lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)
    return out if parts == 1 else out.withColumn(output, F.array_sort(output, order))


def _finder(held, least: float):
    seen = PlainHashes()

    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.Series:
        names = ("item_id", "start", "end", "similarity", "distance")
        found = find_items(texts.tolist(), held.value, seen, least)
        return pd.Series([[dict(zip(names, m, strict=True)) for m in matches] for matches in found], dtype=object)

    return find


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, load(spark, sf_dir, "benchmark"))
    # The outer form: a plain explode would infer a filter on the matches, and they would be searched twice.
    return found.select("doc_id", F.explode_outer("matches").alias("m")).where("m IS NOT NULL").select("doc_id", "m.*")
