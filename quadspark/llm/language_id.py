"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training texts:
whole ones, and stretches of longer ones where those leave room. A text is cut into chunks, every chunk is encoded against every
dictionary, and the language with the fewest bytes in all wins; a narrow margin
marks the row as rejected. The whole text is encoded, in one pass without any
shuffle.

Only the dictionaries are broadcast: ``dict_bytes`` for each distinct language,
of which there may be ``most_languages``; more are an error, not a cut.

Defined results: a null text, or one without a letter (Unicode category L), is
``und`` with score 0; equal texts get equal results; with nothing to learn from,
every row is ``und``; equal byte counts are decided by the bytes of each distinct
word encoded by itself, then by the longest words that a dictionary holds whole,
then by name; repeated rows, null ids and other columns change nothing, copies of
a text are learned once, and a column of the output's name is replaced.
"""

from __future__ import annotations

import math

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, load, sample_rates, share

#: ASCII that is no letter becomes a space; bytes of other characters stay.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-case words of letters with single spaces between, so that marks and digits don't vote."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())


RESULT = "lang_pred string, score double, margin double, rejected boolean"


#: Stretches that stand for a text too long for a dictionary.
PIECES = 8


def _stretches(text: Column, most: int) -> Column:
    """``PIECES`` stretches of a long text at even distances, of at most ``most`` characters together."""
    size = max(1, most // PIECES)
    step = F.floor(F.greatest(F.length(text) - size, F.lit(0)) / (PIECES - 1)).cast("int")
    return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(text, i * step + 1, F.lit(size))))


def fit_dictionaries(
    df: DataFrame, train: Column, text: str = "text", lang: str = "lang", dict_bytes: int = 112_000, sample_rows: int = 800, most_languages: int = 256
) -> dict[str, bytes]:
    """A raw dictionary for each language, of at most ``dict_bytes`` bytes of texts.

    The fit is on a bounded sample: about ``sample_rows`` distinct texts of a
    language, chosen by a hash of the text. Whole texts of at most an eighth of
    ``dict_bytes`` come first, in the order of that hash; where they leave room,
    ``PIECES`` stretches of each longer text, at even distances over the whole of
    it, until the next does not fit. So a language of long texts only is learned too.
    """
    known = df.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    rates = sample_rates(counts.items(), sample_rows)
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("lang"))
    most = dict_bytes // 8
    long = F.octet_length("text") > most
    chosen = known.withColumn("at", share(F.col("text"), 17)).where(F.col("at") < rate)
    chosen = chosen.select("lang", "at", long.alias("long"), F.when(long, _stretches(F.col("text"), most)).otherwise(F.col("text")).alias("text")).distinct()
    running = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("long", "at", "text"))
    rows = chosen.withColumn("size", running).where(F.col("size") <= dict_bytes).select("lang", "long", "at", "text").collect()
    out: dict[str, bytes] = {}
    for name in sorted(counts):
        texts = [r[3] for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:])]
        out[name] = b"\n".join(map(letters, texts)) or b" "
    return out


class Classifier:
    """Byte counts of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, chunk_bytes: int = 2_000):
        self.names = sorted(dictionaries)
        self.bodies = [dictionaries[n] for n in self.names]
        self.chunk = chunk_bytes
        self.coders = []
        for name in self.names:
            d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstd.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        chunks = [b" " + data[i : i + self.chunk] for i in range(0, max(1, len(data)), self.chunk)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.coders]

    def _alone(self, i: int, data: bytes) -> tuple[int, int]:
        """Bytes of the distinct words by themselves under one dictionary, and the letters of those it has whole, negative."""
        words = {b" " + w + b" " for w in data.split()}
        return sum(len(self.coders[i].compress(w)) for w in words), -sum(len(w) for w in words if w in self.bodies[i])

    def classify(self, text: str | None, temperature: float, least_margin: float) -> tuple[str, float, float, bool]:
        if not self.names or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        data = letters(text)
        got = self.sizes(data)
        tied = [i for i, x in enumerate(got) if x == min(got)]
        if len(tied) > 1:  # too short for a byte's difference
            own = {i: self._alone(i, data) for i in tied}
            tied.sort(key=lambda i: (own[i], i))
        best = tied[0]
        others = sorted(x for i, x in enumerate(got) if i != best)
        margin = (others[0] - got[best]) / max(got[best], 1) if others else 1.0
        score = 1.0 / sum(math.exp(-min(60.0, (x - got[best]) / temperature)) for x in got)
        return self.names[best], score, margin, margin < least_margin


def identify_language(
    df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", temperature: float = 4.0, least_margin: float = 0.01,
    output: str = "language",
) -> DataFrame:
    """``df`` with the struct ``output``: lang_pred, score, margin, rejected (margin under ``least_margin``)."""
    held = df.sparkSession.sparkContext.broadcast(dictionaries)
    made: list[Classifier] = []

    @F.pandas_udf(RESULT)
    def classify(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Classifier(held.value))
        return pd.DataFrame([made[0].classify(t, temperature, least_margin) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return df.withColumn(output, classify(F.col(text)))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = is_held_out(F.col("doc_id"), 5, 0)
    out = identify_language(docs, fit_dictionaries(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.margin", "language.rejected")
