"""Pipe-separated terminology files: readers with fixed columns, fill-down, labels, hierarchy, mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as v
from .store import QuadStore

U = "http://umls/"

# The column orders of the file formats.
COLUMNS = {
    "MRRANK": "rank terminology tty suppress",
    "MRCONSO": "cui lang ts lui stt sui is_pref aui saui scui sdui terminology tty code term srl suppress cvf",
    "MRREL": "cui1 aui1 stype1 rel cui2 aui2 stype2 rela rui srui terminology sl group direct suppress cvf",
    "MRSAT": "cui lui sui metaui stype code atui satui atn terminology atv suppress cvf",
    "MRDEF": "cui aui atui satui terminology def suppress cvf",
    "MRSTY": "cui tui stn sty atui cvf",
}
SUPPRESSED = "OEY"


#: Columns that are left empty where they repeat the row before, in files that are written that way.
FILLED = {"MRREL": "cui1 aui1 stype1 rel", "MRSAT": "cui lui sui metaui"}


def read(spark: SparkSession, path: str, kind: str, filled: bool = False) -> DataFrame:
    """A file, folder or compressed part as a frame with the kind's columns, and ``line`` in reading order.

    ``filled`` gives empty columns of FILLED the value of the row before, file by file.
    """
    rows = _read(spark, path, kind)
    return fill_down_files(rows, FILLED[kind].split()) if filled else rows


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    names = COLUMNS[kind].split()
    parts = F.split("value", r"\|")
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = text.withColumn("line", F.monotonically_increasing_id()).where("value <> ''")
    return rows.select(*(F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), "line", "file", "block")


def fill_down(rows: DataFrame, columns: list[str], group: list[str], order: list[str]) -> DataFrame:
    """Nulls take the last value before them in the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_down_files(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in the file; (file, block, line) say where a row stands.

    A block of a file is filled by itself; what the blocks before it end with is
    carried over through a row for each block, so a large file is many tasks.
    """
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({f"_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = rows.groupBy("file", "block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in columns))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", *(F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in columns))
    out = filled.join(carried, ["file", "block"])
    return out.select(*(F.coalesce(f"_{c}", f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def preferred(rows: DataFrame, concept: str, label: str, *priority: Column) -> DataFrame:
    """(concept, label, preferred): the label of highest priority, by a grouped minimum rather than a window."""
    best = rows.groupBy(concept).agg(F.min(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(priority)), F.col(label).alias("label"))).alias("m"))
    return best.select(F.col(concept).alias("concept"), F.col("m.label").alias("label"))


def concepts(conso: DataFrame, rank: DataFrame, terminologies: list[str] | None = None, langs: list[str] | None = None, remove: str = SUPPRESSED) -> DataFrame:
    """(terminology, code, label, synonyms): kept rows, best-ranked term first."""
    kept = conso.where(~F.coalesce("suppress", F.lit("N")).isin(*remove))
    kept = kept.where(F.col("terminology").isin(*terminologies)) if terminologies else kept
    kept = kept.where(F.col("lang").isin(*langs)) if langs else kept
    ranked = kept.join(F.broadcast(rank.select("terminology", "tty", F.col("rank").cast("int").alias("rank"))), ["terminology", "tty"], "left")  # a row for each term type
    ordered = F.array_sort(F.collect_set(F.struct((-F.coalesce("rank", F.lit(0))).alias("k"), "term")))
    return ranked.groupBy("terminology", "code").agg(ordered.alias("t")).select(
        "terminology", "code", F.col("t")[0]["term"].alias("label"), F.array_except(F.transform("t", lambda x: x["term"]), F.array(F.col("t")[0]["term"])).alias("synonyms")
    )


def relations(rel: DataFrame, conso: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents (s, o), others (s, kind, o, quantifier)) between codes; PAR and CHD make the hierarchy."""
    code = lambda n: conso.select(F.col("aui").alias(f"aui{n}"), F.concat_ws("/", "terminology", "code").alias(f"code{n}"))
    kept = rel.where(~F.coalesce("suppress", F.lit("N")).isin(*SUPPRESSED)).join(code(1), "aui1").join(code(2), "aui2").where("code1 <> code2")
    up = kept.where("rel = 'PAR'").select(F.col("code1").alias("s"), F.col("code2").alias("o"))
    down = kept.where("rel = 'CHD'").select(F.col("code2").alias("s"), F.col("code1").alias("o"))
    other = kept.where("rel NOT IN ('PAR', 'CHD', 'SIB')").select(
        F.col("code2").alias("s"), F.coalesce("rela", "rel").alias("kind"), F.col("code1").alias("o"), F.when(F.col("direct") == "Y", "some").otherwise("only").alias("quantifier")
    )
    return up.unionByName(down).distinct(), other.distinct()


def concept_links(conso: DataFrame) -> DataFrame:
    """(code, concept): codes and the concept that they share."""
    return conso.select(F.concat_ws("/", "terminology", "code").alias("code"), F.col("cui").alias("concept")).distinct()


def interval_parents(codes: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(s, parent) of numeric codes (s) in groups (parent, low, high): an interval join on bins of ``width``.

    A group is listed under each bin it touches and a code under its own, so the
    join is on equal bins; the narrowest group wins, and the last of equals.
    """
    bins = groups.select("parent", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"high div {width}"))).alias("bin"))
    hit = codes.withColumn("bin", F.expr(f"s div {width}")).join(bins, "bin").where("s BETWEEN low AND high")
    best = hit.groupBy("s").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("w"), (-F.col("parent")).alias("k"))).alias("m"))
    return best.select("s", (-F.col("m.k")).alias("parent"))


def load(spark: SparkSession, folder: str, terminologies: list[str] | None = None, langs: list[str] | None = None, graph: str = "umls", filled: bool = False) -> QuadStore:
    """A folder of the files as a store: a class for each code, with label, synonyms, parents, relations, attributes and definitions.

    Concepts are ``terminology/code`` under ``http://umls/``; a shared concept id
    becomes ``mapped_to``. MRCONSO and MRRANK must be there; the others may be missing.
    """

    def part(kind: str) -> DataFrame | None:
        try:
            return read(spark, f"{folder}/{kind}.RRF*", kind, filled and kind in FILLED)
        except AnalysisException:
            return None

    conso = part("MRCONSO")
    kept = conso.where(~F.coalesce("suppress", F.lit("N")).isin(*SUPPRESSED))
    kept = kept.where(F.col("terminology").isin(*terminologies)) if terminologies else kept
    iri = lambda *c: F.concat(F.lit(U), F.concat_ws("/", *c))
    known = concepts(conso, part("MRRANK"), terminologies, langs).withColumn("s", iri("terminology", "code"))
    g = F.lit(graph).alias("c")
    obj = lambda f, p, o: f.select(g, "s", F.lit(p).alias("p"), o.alias("o"))
    data = lambda f, p, x: f.select(g, "s", p.alias("p"), x.alias("lex"), F.lit(None).cast("double").alias("num"), F.lit(v.STRING).alias("d"), F.lit(None).cast("string").alias("lang"))
    codes = kept.select("aui", "cui", iri("terminology", "code").alias("s"))
    objs = [obj(known, v.TYPE, F.lit(v.CLASS)), known.join(kept.select(iri("terminology", "code").alias("s"), "cui").distinct(), "s").select(g, "s", F.lit(U + "mapped_to").alias("p"), F.concat(F.lit(U + "CUI/"), "cui").alias("o"))]
    datas = [data(known, F.lit(v.LABEL), F.col("label")), data(known.select("s", F.explode("synonyms").alias("x")), F.lit(U + "synonyms"), F.col("x"))]
    if (rel := part("MRREL")) is not None:
        up, other = relations(rel, kept)
        objs.append(up.select(g, F.concat(F.lit(U), "s").alias("s"), F.lit(v.SUBCLASS).alias("p"), F.concat(F.lit(U), "o").alias("o")))
        objs.append(other.select(g, F.concat(F.lit(U), "s").alias("s"), F.concat(F.lit(U), "kind").alias("p"), F.concat(F.lit(U), "o").alias("o")))
    own = lambda f, key: f.where(~F.coalesce("suppress", F.lit("N")).isin(*SUPPRESSED)).join(codes.select(F.col("aui").alias(key), "s"), key)
    if (sat := part("MRSAT")) is not None:
        datas.append(data(own(sat, "metaui"), F.concat(F.lit(U), "atn"), F.col("atv")))
    if (defs := part("MRDEF")) is not None:
        datas.append(data(own(defs, "aui"), F.lit(U + "definition"), F.col("def")))
    union = lambda frames: reduce(DataFrame.unionByName, frames).distinct()
    return QuadStore(union(objs), union(datas))


def interval_of_text(codes: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, parent) of codes such as ``A05`` in groups (parent, low, high) such as A00 to A09, by the order of text.

    A group is listed under every first letter it touches, so the join is on equal
    letters; a code's end is compared in the group's own length, so that A09.3 lies
    within A00 to A09. The narrowest group wins, and the last in name of equals.
    """
    letters = F.transform(F.sequence(F.ascii("low"), F.ascii("high")), lambda x: F.char(x))
    spread = groups.select("parent", "low", "high", F.explode(letters).alias("letter"))
    hit = codes.withColumn("letter", F.substring("s", 1, 1)).join(spread, "letter").where("s >= low AND substring(s, 1, length(high)) <= high AND s <> parent")
    inner = hit.groupBy("s").agg(F.max("low").alias("best"))  # groups nest or stand apart: the innermost begins last, and of those ends first
    best = hit.join(inner, "s").where("low = best").groupBy("s").agg(F.min(F.struct("high", "parent")).alias("m"))
    return best.select("s", F.col("m.parent").alias("parent"))
