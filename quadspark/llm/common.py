"""Helpers shared by the corpus operators: word splitting, hashing, row blocks.

Everything here works on one text or one Arrow batch inside a task; Spark does
the partitioning and the shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import pinned as checkpointed  # noqa: F401

_CACHE_LIMIT = 400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % modulus


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the fold is ``remainder``; a row without an id has no fold and counts as held out."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(True))


def share(value: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the value: keeps a bounded share of rows."""
    return F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; bytes.split() cuts at exactly those six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered for repeated words up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, from a rule: hashes of their numbers."""
    return np.array([xxhash.xxh3_64_intdigest(str(i), seed) | 1 for i in range(n)], np.uint64)


def rolling(hashes: np.ndarray, width: int, constants: np.ndarray) -> np.ndarray:
    """A hash for each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * constants[0]
    for k in range(1, width):
        out += hashes[k : k + n] * constants[k]
    return mix64(out)


_SHINGLE = odd_constants(64, 5)


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a text shorter than ``width`` words is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes, min(width, len(hashes)), _SHINGLE))


def pack_sorted(values: np.ndarray) -> bytes:
    """uint64 values by byte plane, so that shared high bytes compress in the shuffle."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").reshape(-1).astype(np.uint64)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def sample_rates(counts: Iterable[tuple[object, int]], bound: int) -> dict:
    """Per group, the share that keeps about ``bound`` rows."""
    return {k: min(1.0, bound / n) for k, n in counts if n}
