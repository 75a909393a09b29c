"""Token ids in Parquet files that can be read in parts.

The files hold a row for each document, in ascending order of doc_id over the
files and in them: ``doc_id``, ``n_tokens``, ``shard`` (number of the file),
``before`` (ids of the documents before it in its file) and ``ids``, a list of
32-bit ids with the end id last. Ids are dictionary encoded, doc_id and the
counts with deltas (page version 2); row groups and pages have set sizes, and
each file has column and offset indexes. So counts are read without ids, and the
ids of some documents or of a range of the stream from their pages only.

Documents are dealt by ranges of (doc_id, hash of the text, row), so that rows of
one doc_id or of none are spread too, and each text is shuffled once and encoded
once. Words between the six ASCII white-space characters are encoded by
themselves and remembered up to a fixed number: the vocabulary drops white space
and joins nothing across it, so the ids are those of the whole text. For a
vocabulary that keeps white space set ``by_word`` to False. Starts are running
sums over the totals of the files, in two levels.

Defined results: a null or empty text has the end id only; a null doc_id comes
first; rows of equal doc_id follow the hash of their texts, and equal rows are
documents each; an empty table gives one empty file; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.closure import shared_dir
from .common import blocks_for, load

SHARDS_A_GROUP, WORDS_KEPT, WORD_BYTES = 1_000, 300_000, 64
#: A mark between a letter a-z and white space or the end: it is a token apart.
MARK = re.compile(rb"[.,;:!?](?<=[a-z].)(?=[\x09-\x0d\x20]|\Z)")
SCHEMA = "doc_id long, n_tokens long, shard int, before long, ids array<int>"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: itself for a visible Latin-1 character, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """word -> its ids as little-endian bytes; the words of late are remembered, up to twice WORDS_KEPT."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.before, self.letters = Tokenizer.from_file(path), {}, byte_letters()
        self.model = self.tokenizer.model

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def made(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII
            return self.merged(word.decode())
        text = word.decode("utf-8", "replace")
        core = text.rstrip(".,;:!?")
        if not core.isalpha() or max(core) >= "ɐ":
            return self.encoded(text)
        # Letters below U+0250 are composed, end before such a mark, and lose case one by one: "Word," is "word" and ",".
        plain, mark = core.lower(), text[len(core) :]
        if mark:
            return self[plain.encode()] + self[mark.encode()]
        if plain != text:
            return self[plain.encode()]
        return self.merged(word.decode("latin-1").translate(self.letters))

    def merged(self, letters: str) -> bytes:
        """Nothing is left to normalise or to cut: the merges alone, which cost a fifth of a whole encoding."""
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word) or self.made(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out

    def of(self, text: str | None) -> bytes:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
            # Neither a mark that joins a letter (U+0300 to U+036F) nor a special token: ASCII case and marks can go before the look-up.
            data = MARK.sub(rb" \g<0>", data.lower())
        return b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for a worker and file."""
    return WordIds(path)


def ids_of(texts: list[str | None], path: str, by_word: bool = True) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    words = word_ids(path)
    if by_word:
        return list(map(words.of, texts))
    return [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


class TokenStore:
    """A folder of token files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def write(
        cls, df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, by_word: bool = True,
        bytes_a_shard: int = 32_000_000, row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10,
    ) -> TokenStore:
        """Encode ``df`` with the vocabulary file ``tokenizer``, which every executor has at that path."""
        docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        tail = np.array([end_id], "<u4").tobytes()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, before = TaskContext.get().partitionId(), 0
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    coded = [x + tail for x in ids_of(part.column("text").to_pylist(), tokenizer, by_word)]
                    n = np.array([len(x) // 4 for x in coded], np.int64)
                    ends = np.cumsum(n)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(n), pa.array(np.full(len(n), shard, np.int32)), pa.array(before + ends - n), ids],
                        ["doc_id", "n_tokens", "shard", "before", "ids"],
                    )
                    before += int(ends[-1])

        order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
        dealt = docs.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(blocks_for(size, bytes_a_shard), *order)
        (
            dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, SCHEMA).write.option("compression", "zstd")
            .option("parquet.writer.version", "v2").option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
            .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", str(4 << 20))
            .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false").option("parquet.enable.dictionary#before", "false")
            .parquet(folder)
        )
        return cls(df.sparkSession, folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def shards(self) -> DataFrame:
        """(shard, shard_start, tokens): ids in the files before, and in each; from the counts only."""
        totals = self.rows().groupBy("shard").agg(F.sum("n_tokens").alias("tokens")).withColumn("group", F.floor(F.col("shard") / SHARDS_A_GROUP))
        running = lambda by, order: F.coalesce(F.sum("tokens").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = totals.groupBy("group").agg(F.sum("tokens").alias("tokens")).select("group", running(F.lit(0), "group").alias("earlier"))
        inside = totals.withColumn("inside", running("group", "shard"))
        return inside.join(groups, "group").select("shard", (F.col("earlier") + F.col("inside")).alias("shard_start"), "tokens")

    def index(self) -> DataFrame:
        """(doc_id, start, n_tokens): no ids are read."""
        return self.rows().select("doc_id", "n_tokens", "shard", "before").join(self.shards(), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens")

    def documents(self, least: int, most: int) -> DataFrame:
        """(doc_id, ids) of the documents whose doc_id lies between, both ends included: files, row groups and pages of others are skipped."""
        return self.rows().where(F.col("doc_id").between(least, most)).select("doc_id", "ids")

    def stream(self, start: int, stop: int) -> DataFrame:
        """(doc_id, start, ids): the ids at the places start to stop, end exclusive, of all documents' ids in a row."""
        held = self.shards().where((F.col("shard_start") < stop) & (F.col("shard_start") + F.col("tokens") > start)).collect()  # the files of the range
        out = None
        for shard, first, _ in held:
            rows = self.rows().where((F.col("shard") == shard) & (F.col("before") < stop - first) & (F.col("before") + F.col("n_tokens") > start - first))
            at = F.col("before") + F.lit(first)
            skip = F.greatest(F.lit(0), F.lit(start) - at).cast("int")
            part = rows.select("doc_id", (at + skip).alias("start"), F.slice("ids", skip + 1, F.least(F.lit(stop) - at, F.col("n_tokens")).cast("int") - skip).alias("ids"))
            out = part if out is None else out.unionByName(part)
        return self.rows().select("doc_id", F.col("before").alias("start"), "ids").where("false") if out is None else out

    def checksums(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) from the ids in the files."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("ids")
                at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
                crc = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
                count = pa.array(np.diff(at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), count, batch.column("shard"), batch.column("before"), crc], ["doc_id", "n_tokens", "shard", "before", "ids_crc32"])

        read = self.rows().select("doc_id", "shard", "before", "ids").mapInArrow(sums, "doc_id long, n_tokens long, shard int, before long, ids_crc32 long")
        return read.join(self.shards(), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return TokenStore.write(load(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")).checksums()
