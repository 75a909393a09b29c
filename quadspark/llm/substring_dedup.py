"""Substring deduplication with difference-cover anchors.

A window of ``window`` consecutive words goes where the same word sequence also
starts earlier (in a smaller doc_id, or earlier in the same document). Hashing
every window would shuffle every position. Instead, short anchors are hashed
only at positions whose remainder modulo a period lies in a difference cover: of
any two equal windows some shift under the period puts both on a cover position,
so they share an aligned anchor. Anchors that occur once anywhere rule their
windows out; the windows around the others are extended to full length, hashed
with 128 bits and matched exactly.

Documents are dealt into blocks of about ``chars_a_block`` characters by doc_id and
a hash of the text, so that neither copies nor rows of one id meet in one block. A
block sends each distinct anchor (later: window) once to the bucket of its hash
range, whatever the number of copies it holds, and gets back one bit for each. So
a passage that a third of all rows share costs one entry for each block, no pairs
are made, and no group grows with the number of copies. The rows sent are blocks x
buckets, at most one for each anchor; larger blocks and buckets make fewer.

Defined results: a null or empty text has no words and nothing removed; windows
are judged on the input; a null doc_id is the smallest; rows of equal doc_id are
ordered by the unsigned hash of their text, and equal rows one after the other;
other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, load, odd_constants, pack_sorted, rolling, split_words, unpack_sorted

#: Perfect difference sets: modulo the period, every shift is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
LEAST_ANCHOR = 5
NO_ID, MOST_TASKS = -(1 << 63), 20_000
_PART = "bucket int, block int, data binary, more binary, ids binary"
_BITS = "block int, bucket int, kind int, bits binary"
ANCHOR, WINDOW = 0, 1


class Plan:
    """Window length, period, cover and anchor length."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.period = max((p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, window)), default=1)
        self.anchor = window - self.period + 1
        self.cover = np.zeros(self.period, bool)
        self.cover[list(COVERS[self.period])] = True
        self.constants = odd_constants(self.anchor, 11)
        self.full = odd_constants(window, 12), odd_constants(window, 13)

    def cuts(self, hashes: np.ndarray) -> np.ndarray:
        """Where each bucket begins among sorted hashes."""
        edges = (np.arange(1, self.buckets, dtype=np.float64) * (2.0**64 / self.buckets)).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)


class WordNumbers(dict):
    """word -> its number; two 64-bit hashes of different seeds for each number."""

    def __init__(self):
        self.one, self.two = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.one)
        self.one.append(xxhash.xxh3_64_intdigest(word))
        self.two.append(xxhash.xxh3_64_intdigest(word, 1))
        return number


class Block:
    """The word hashes of a block's documents, one after the other in the order of documents; the words only where they are asked for."""

    def __init__(self, rows: pd.DataFrame, plan: Plan, keep_words: bool = False):
        self.plan = plan
        ids, texts = rows["doc_id"].tolist(), rows["text"].tolist()
        keys = [NO_ID if pd.isna(i) else int(i) for i in ids]
        spread = (rows["spread"].to_numpy(np.int64).view(np.uint64)).tolist()
        order = sorted(range(len(ids)), key=lambda i: (keys[i], spread[i], texts[i] or ""))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.ids = [None if pd.isna(ids[i]) else keys[i] for i in order]
        self.words: list[list[bytes]] = []
        numbers, each = WordNumbers(), [np.empty(0, np.int32)]
        for i in order:
            words = split_words(texts[i])
            each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            if keep_words:
                self.words.append(words)
        lengths = np.array([len(x) for x in each[1:]], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        number = np.concatenate(each)
        self.hashes = np.frombuffer(numbers.one, np.uint64)[number] if len(number) else np.empty(0, np.uint64)
        self.others = np.frombuffer(numbers.two, np.uint64)[number] if len(number) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.pos = np.arange(len(self.hashes)) - self.starts[self.doc]
        self.left = lengths[self.doc] - self.pos  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, and the distinct hashes with each place's index in them and their counts."""
        p = self.plan
        at = np.flatnonzero(p.cover[self.pos % p.period] & (self.left >= p.anchor))
        all_hashes = rolling(self.hashes, p.anchor, p.constants)[at] if len(at) else np.empty(0, np.uint64)
        distinct, index, counts = np.unique(all_hashes, return_inverse=True, return_counts=True)
        return at, distinct, index, counts

    def windows(self, bits: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """Candidate windows: places, both halves of their hashes, index of each in the distinct ones, first places."""
        p = self.plan
        at, distinct, index, _ = self.anchors()
        repeated = flags(bits, p.cuts(distinct))[index] if len(at) else np.zeros(0, bool)
        hit = at[repeated]
        near = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(near, np.maximum(hit - p.period + 1, self.starts[self.doc[hit]]), 1)
        np.add.at(near, hit + 1, -1)
        places = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= p.window))
        one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
        for k in range(p.window):
            one += self.hashes[places + k] * p.full[0][k]
            two += self.others[places + k] * p.full[1][k]
        order = np.lexsort((two, one))  # stable: places stay in order
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return places, a[new], b[new], group, places[order][new]


def flags(bits: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    """The buckets' bits, put together in hash order."""
    out = np.zeros(cuts[-1], bool)
    for bucket, data in bits.items():
        a, b = cuts[bucket], cuts[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
    return out


def _bits_of(rows: pd.DataFrame, kind: int) -> dict[int, bytes]:
    kept = rows[rows["kind"] == kind]
    return dict(zip(kept["bucket"], kept["bits"], strict=True))


def _parts(block: int, cuts: np.ndarray, *columns: np.ndarray | None) -> pd.DataFrame:
    """A row for each bucket that the block has hashes in."""
    out = []
    for k in np.flatnonzero(np.diff(cuts)):
        cut = slice(cuts[k], cuts[k + 1])
        out.append((int(k), block, *(None if c is None else np.packbits(c[cut]).tobytes() if c.dtype == bool else pack_sorted(c[cut]) for c in columns)))
    return pd.DataFrame(out, columns=["bucket", "block", "data", "more", "ids"])


def _answer(rows: pd.DataFrame, lengths: list[int], marked: np.ndarray, kind: int) -> pd.DataFrame:
    ends = np.cumsum(lengths)
    bits = [np.packbits(marked[e - n : e]).tobytes() for e, n in zip(ends, lengths, strict=True)]
    return pd.DataFrame({"block": rows["block"].astype("int32"), "bucket": rows["bucket"].astype("int32"), "kind": np.int32(kind), "bits": bits})


def _repeated_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits for the anchors that occur in another block too, or twice in their own."""
    each = [unpack_sorted(d) for d in rows["data"]]
    twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(e)) for m, e in zip(rows["more"], each, strict=True)]).astype(bool)
    _, index, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    return _answer(rows, [len(e) for e in each], twice | (counts[index] > 1), ANCHOR)


def _later_windows(rows: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """Bits for the windows whose first document is not the first of all."""
    each = [unpack_sorted(d) for d in rows["data"]]
    one, two = np.concatenate(each), np.concatenate([unpack_sorted(d) for d in rows["more"]])
    ids = np.concatenate([unpack_sorted(d) for d in rows["ids"]]).view(np.int64)
    block = np.repeat(rows["block"].to_numpy(np.int64), [len(e) for e in each])
    # Rows of one id lie in blocks by the hash of their texts, counted on from the id's own place.
    order = np.lexsort(((block - ids % blocks) % blocks, ids, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    later = np.empty(len(order), bool)
    later[order] = ~new
    return _answer(rows, [len(e) for e in each], later, WINDOW)


def dedup_substrings(
    df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 20, chars_a_block: int = 6_000_000, chars_a_bucket: int = 24_000_000
) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_words, n_removed, kept (words joined by one space), removed.

    ``removed`` lists the (start, end) word ranges that went, end exclusive.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, plan = blocks_for(chars, chars_a_block), Plan(window, blocks_for(chars, chars_a_bucket))
    spread = F.xxhash64(F.coalesce("text", F.lit("")))
    # The hash's place among the blocks, in its unsigned order, counted on from the id's own place.
    share = F.shiftright(F.shiftrightunsigned(spread, 33) * F.lit(blocks).cast("long"), 31)
    own = F.pmod(F.coalesce("doc_id", F.lit(NO_ID)), F.lit(blocks).cast("long"))
    dealt = docs.withColumns({"spread": spread, "block": F.pmod(own + share, F.lit(blocks)).cast("int")})

    def send_anchors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, distinct, _, counts = Block(rows, plan).anchors()
        return _parts(int(key[0]), plan.cuts(distinct), distinct, counts > 1, None)

    def send_windows(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(bits):
            return _parts(0, np.zeros(1, np.int64))
        b = Block(rows, plan)
        _, one, two, _, first = b.windows(_bits_of(bits, ANCHOR))
        return _parts(int(key[0]), plan.cuts(one), one, two, b.keys[b.doc[first]].view(np.uint64))

    def cut(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows, plan, keep_words=True)
        places, one, _, group, first = b.windows(_bits_of(bits, ANCHOR))
        later = flags(_bits_of(bits, WINDOW), plan.cuts(one))
        gone = places[later[group] | (first[group] != places)]
        cover = np.zeros(len(b.hashes) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        out = []
        for i, words in enumerate(b.words):
            mask = removed[b.starts[i] : b.starts[i + 1]]
            n, ranges = int(mask.sum()), []
            if n:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                ranges = edges.reshape(-1, 2).tolist()
                kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            else:
                kept = words
            out.append((b.ids[i], len(words), n, b" ".join(kept).decode("utf-8", "surrogatepass"), ranges))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "removed"])
        return frame.astype({"doc_id": "Int64"})

    # As many partitions as blocks and buckets, so that a task's part does not grow with the corpus.
    tasks, ranges = min(blocks, MOST_TASKS), min(plan.buckets, MOST_TASKS)
    at_block = lambda rows: rows.repartition(tasks, "block").groupBy("block")
    at_bucket = lambda rows: rows.repartition(ranges, "bucket").groupBy("bucket")
    by_block = at_block(dealt)
    anchor_bits = at_bucket(by_block.applyInPandas(send_anchors, _PART)).applyInPandas(_repeated_anchors, _BITS)
    windows = by_block.cogroup(at_block(anchor_bits)).applyInPandas(send_windows, _PART)
    window_bits = at_bucket(windows).applyInPandas(lambda rows: _later_windows(rows, blocks), _BITS)
    return by_block.cogroup(at_block(anchor_bits.unionByName(window_bits))).applyInPandas(
        cut, "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>"
    )


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
