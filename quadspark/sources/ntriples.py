"""N-Triples and N-Quads as text columns: read with regular expressions, written with concat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import escape, number, unescape
from .store import QuadStore

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:\S+)|"([^"]*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
#: Stand-ins for an escaped quote and an escaped back slash, so that a literal ends at the first plain quote however long it is.
QUOTE, SLASH = "\u0001", "\u0002"
STRING = "http://www.w3.org/2001/XMLSchema#string"


def _name(x: Column, scope: Column) -> Column:
    """An IRI without its brackets; a blank node's label under its file's scope."""
    return F.when(F.startswith(x, F.lit("<")), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.concat(F.lit("_:"), scope, F.substring(x, F.lit(3), F.length(x))))


def parse_lines(lines: DataFrame, graph: str, column: str = "value", scope: Column | None = None) -> QuadStore:
    """A store of the lines; blank lines and comments are skipped, a malformed line fails the read when it is reached."""
    scope = F.lit("") if scope is None else scope
    kept = lines.where(~F.col(column).rlike(r"^\s*(#.*)?$")).withColumn("_scope", scope)
    plain = F.replace(F.replace(F.col(column), F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))
    kept = kept.withColumn("_plain", plain)
    part = lambda i: F.regexp_extract("_plain", LINE, i)
    checked = F.when(F.col("_plain").rlike(LINE), part(1)).otherwise(F.raise_error(F.concat(F.lit("malformed triple: "), F.col(column))))
    rows = kept.select("_scope", checked.alias("s"), part(2).alias("p"), part(3).alias("o"), F.replace(F.replace(part(4), F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\")).alias("lex"), part(5).alias("lang"), part(6).alias("d"))
    base = rows.select(F.lit(graph).alias("c"), _name(F.col("s"), F.col("_scope")).alias("s"), "p", "o", "lex", "lang", "d", "_scope")
    objs = base.where("o <> ''").select("c", "s", "p", _name(F.col("o"), F.col("_scope")).alias("o"))
    d = F.when(F.col("lang") != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#PlainLiteral")).when(F.col("d") == "", F.lit(STRING)).otherwise(F.col("d"))
    datas = base.where("o = ''").select("c", "s", "p", unescape(F.col("lex")).alias("lex"), d.alias("d"), F.nullif("lang", F.lit("")).alias("lang"))
    return QuadStore(objs.dropDuplicates(), datas.select("c", "s", "p", "lex", number(F.col("lex"), F.col("d")).alias("num"), "d", "lang").dropDuplicates())


def read(spark, path: str, graph: str) -> QuadStore:
    """Files of triples. Blank nodes are a file's own; the part files of one folder are one file."""
    whole = F.regexp_replace(F.input_file_name(), "/part-[^/]*$", "")
    return parse_lines(spark.read.text(path), graph, scope=F.concat(F.hex(F.xxhash64(whole)), F.lit("-")))


def _show(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit("_:")), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))


def lines(store: QuadStore, quads: bool = False, graph_first: bool = False) -> DataFrame:
    """(line) for each triple or quad; untyped text carries no datatype."""
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("d").isNull() | (F.col("d") == STRING), "").otherwise(F.concat(F.lit("^^<"), "d", F.lit(">")))
    literal = F.concat(F.lit('"'), escape(F.col("lex")), F.lit('"'), suffix)
    each = store.quads.select("c", _show(F.col("s")).alias("s"), _show(F.col("p")).alias("p"), F.coalesce(_show(F.col("o")), literal).alias("x"))
    graph = F.concat(F.lit("<"), "c", F.lit(">"))
    order = [graph, "s", "p", "x", F.lit(".")] if quads and graph_first else ["s", "p", "x", graph, F.lit(".")] if quads else ["s", "p", "x", F.lit(".")]
    return each.select(F.concat_ws(" ", *order).alias("line"))


def write(store: QuadStore, path: str, keep: Column | None = None, quads: bool = False) -> None:
    """Text files of the triples; ``keep`` filters the rows (a Column over both kinds)."""
    if keep is not None:
        store = QuadStore(store.objs.where(keep), store.datas.where(keep), store.inverses)
    lines(store, quads).write.mode("overwrite").text(path)
