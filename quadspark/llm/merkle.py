"""Document fingerprints: a Merkle tree over sections and paragraphs.

Lines that are not blank are paragraphs. A paragraph longer than ``PIECE`` words
is cut into pieces after words whose hash is a multiple of ``PIECE``, so that
cuts follow the content and an edit moves only the cuts beside it. Sections are
runs of leaves that end at a blank line or after a leaf whose hash is a multiple
of ``SECTION``. Leaf hashes make section hashes, section hashes make the root.

The printed fingerprint is ``root:section,section,...`` with each section as
``hash[leaf.words leaf.words ...]``: equal roots mean equal texts. A comparison
puts the sections of two trees side by side in their order, goes down only into
those that differ, and gives the word ranges of the leaves that differ: where
either text was edited. Likeness is the share of words outside those ranges, so
moved paragraphs count as edits.

Defined results: a null text is an empty one, whose tree has no section; the
root is taken over the whole text, so white space alone also tells texts apart
(such texts are alike by 1.0 and differ in no word); two fingerprints without
leaves are alike (1.0), one against a text with leaves is not (0.0); rows of
equal doc_id are ordered by text, equal rows one after the other; a row without a
doc_id has no place in the order, and its next document is an empty one; other
columns change nothing, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, load

PIECE, SECTION = 12, 8
ROWS_A_BLOCK, MOST_BLOCKS = 2_000, 50_000


def leaves(text: str) -> list[list[tuple[str, int]]]:
    """Sections of (leaf hash, words)."""
    sections: list[list[tuple[str, int]]] = []
    now: list[tuple[str, int]] = []

    def close() -> None:
        if now:
            sections.append(now.copy())
            now.clear()

    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            close()
            continue
        if len(words) <= PIECE:
            pieces = [words]
        else:
            ends = [i + 1 for i, w in enumerate(words) if xxhash.xxh3_64_intdigest(w, i and xxhash.xxh32_intdigest(words[i - 1])) % PIECE == 0]
            ends = [0, *ends] if ends and ends[-1] == len(words) else [0, *ends, len(words)]
            pieces = [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for p in pieces:
            value = xxhash.xxh3_64_intdigest(b" ".join(p))
            now.append((f"{value:016x}", len(p)))
            if value % SECTION == 0:
                close()
    close()
    return sections


def fingerprint(text: str | None) -> str:
    text = text or ""
    printed = []
    for section in leaves(text):
        body = " ".join(f"{h}.{n}" for h, n in section)
        printed.append(f"{xxhash.xxh3_64_hexdigest(body)}[{body}]")
    tree = ",".join(printed)
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return f"{hashlib.blake2b(whole + tree.encode(), digest_size=16).hexdigest()}:{tree}"


def parse(printed: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    root, _, tree = printed.partition(":")
    sections = []
    for part in tree.split(",") if tree else []:
        head, _, body = part[:-1].partition("[")
        sections.append((head, [(h, int(n)) for h, _, n in (x.partition(".") for x in body.split(" "))]))
    return root, sections


def in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places at which two lists agree, ascending on both sides.

    The equal ends of the lists, and between them the longest ascending run of
    the k-th occurrence here against the k-th occurrence there: n log n steps.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)  # the earliest is taken first
    least: list[int] = []  # least[k]: the least place there that ends an ascending run of k + 1 pairs
    ends: list[int] = []
    pairs: list[tuple[int, int, int]] = []  # here, there, the pair before it in its run
    for i in range(head, len(a) - tail):
        if left := where.get(a[i]):
            j = left.pop()
            k = bisect_left(least, j)
            pairs.append((i, j, ends[k - 1] if k else -1))
            least[k : k + 1], ends[k : k + 1] = [j], [len(pairs) - 1]
    middle, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = pairs[at]
        middle.append((i, j))
    return [*((i, i) for i in range(head)), *reversed(middle), *((len(a) - t, len(b) - t) for t in range(tail, 0, -1))]


def _gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """The stretches (from, to, from, to) between pairs of places."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i or y > j:
            yield i, x, j, y
        i, j = x + 1, y + 1


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Word ranges (from, to) of the first text and (from, to) of the second that differ, in order; equal branches are not opened."""
    (root_a, left), (root_b, right) = parse(a), parse(b)
    if root_a == root_b:
        return []
    starts = []
    for side in (left, right):
        at = [0]
        for _, own in side:
            at.append(at[-1] + sum(n for _, n in own))
        starts.append(at)
    out: list[tuple[int, int, int, int]] = []
    for i, x, j, y in _gaps(in_order([h for h, _ in left], [h for h, _ in right]), len(left), len(right)):
        one, two = [leaf for _, own in left[i:x] for leaf in own], [leaf for _, own in right[j:y] for leaf in own]
        ends = [list(accumulate((n for _, n in leaves), initial=start)) for leaves, start in ((one, starts[0][i]), (two, starts[1][j]))]
        for k, z, m, w in _gaps(in_order([h for h, _ in one], [h for h, _ in two]), len(one), len(two)):
            out.append((ends[0][k], ends[0][z], ends[1][m], ends[1][w]))
    return out


def likeness(a: str, b: str) -> float:
    """Share of words outside the edits, of both texts together; 1 for equal roots."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    words = lambda p: sum(n for _, own in parse(p)[1] for _, n in own)
    total = words(a) + words(b)
    if not total:
        return 1.0
    return 1.0 - sum(x - i + y - j for i, x, j, y in edits(a, b)) / total


EDITS = "array<struct<start:int,end:int,other_start:int,other_end:int>>"


def locate_edits(df: DataFrame, left: str = "fingerprint", right: str = "edited_fingerprint", output: str = "edits") -> DataFrame:
    """``df`` with the word ranges in which the texts of two fingerprint columns differ."""

    @F.pandas_udf(EDITS)
    def find(one: pd.Series, two: pd.Series) -> pd.Series:
        names = ("start", "end", "other_start", "other_end")
        return pd.Series([[dict(zip(names, e, strict=True)) for e in edits(a or fingerprint(None), b or fingerprint(None))] for a, b in zip(one, two, strict=True)], dtype=object)

    return df.withColumn(output, find(F.col(left), F.col(right)))


def fingerprints(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """``df`` with its texts' fingerprints in ``output``; a column of that name is replaced."""

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return df.withColumn(output, make(F.col(text)))


def with_next(df: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(block, last, doc_id, text): documents in blocks of descending doc_id, each block ending with the next one's first.

    Bounds are quantiles of doc_id (a bounded list), so blocks are ranges; the
    document on a bound is also sent to the block before its own, and the first
    of all to the last block. Only those few rows are sent twice.
    """
    keyed = df.select("doc_id", "text", F.col("doc_id").alias("key"))
    blocks = min(blocks_for(df.count(), rows_a_block), MOST_BLOCKS)
    shares = [i / blocks for i in range(1, blocks + 1)]
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", shares, max(10_000, 20 * blocks))).first()[0] or [])) or [0]
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(edges, keys.to_numpy(np.int64)), len(edges) - 1).astype(np.int32))

    @F.pandas_udf("array<int>")
    def before(keys: pd.Series, blocks: pd.Series) -> pd.Series:
        out = []
        for key, block in zip(keys, blocks, strict=True):
            first = key == edges[block]  # the greatest id of its block comes first in it
            out.append([] if not first else [block + 1] if block + 1 < len(edges) else [0])
        return pd.Series(out, dtype=object)

    placed = keyed.withColumn("block", block_of("key")).withColumn("before", before("key", "block"))
    own = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("last")))
    again = F.transform("before", lambda b: F.struct(b.alias("block"), F.lit(True).alias("last")))
    return placed.select("doc_id", "key", "text", F.explode(F.concat(own, again)).alias("at")).select("at.*", "doc_id", "key", "text")


def compare_with_next(df: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """For each document: its fingerprint, that of its text with the last third from the next document, and likenesses.

    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next, edits. Rows of equal doc_id are ordered by text.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = with_next(docs.where("doc_id IS NOT NULL"), rows_a_block)
    sorted_blocks = blocks.repartition("block").sortWithinPartitions("block", "last", F.desc("key"), "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (block, doc_id, text, fingerprint) that waits for its next document
        for rows in batches:
            out = []
            for block, last, doc_id, text in zip(rows["block"], rows["last"], rows["doc_id"], rows["text"], strict=True):
                printed = fingerprint(text)
                if held is not None and held[0] == block:
                    out.append(_compared(held[1], held[2], held[3], text, printed))
                held = None if last else (block, int(doc_id), text, printed)
            yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [_compared(None, text, fingerprint(text), "", fingerprint("")) for text in rows["text"]]
            yield pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    return sorted_blocks.mapInPandas(walk, _SHAPE).unionByName(docs.where("doc_id IS NULL").mapInPandas(alone, _SHAPE))


_SHAPE = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<array<int>>"
_NAMES = [x.split()[0] for x in _SHAPE.split(", ")]


def _compared(doc_id: int | None, own: str, printed: str, following: str, next_printed: str) -> tuple:
    cut = len(own) // 3
    edited = own[: len(own) - cut] + following[:cut]
    edited_print = fingerprint(edited)
    found = [list(e) for e in edits(printed, edited_print)]
    return doc_id, len(own), edited, printed, edited_print, likeness(printed, edited_print), likeness(printed, next_printed), found


def op7_merkle_fingerprint(spark, sf_dir: str) -> DataFrame:
    out = compare_with_next(load(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("edits", lambda e: F.array_join(e.cast("array<string>"), ":")), ",")  # word ranges of either text
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", ranges.alias("edits"))
