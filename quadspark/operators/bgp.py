"""Graph patterns as a DataFrame builder: basic patterns, optional, minus, union, filter, group, paths.

    Pattern(store).triple("?c", IN_NATION, "?n").data("?n", NAME, "?name").select("c", "name")

Variables are columns. A pattern on a property also finds triples stored under
its inverse. There is no query text: the builder is the language.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.terms import literal_lex, number
from ..sources.store import QuadStore
from .closure import closure_pairs, reachable
from .rules import is_var


@dataclass(frozen=True)
class Literal:
    """A literal in an update's template: a value or a ``?column``."""

    value: object
    datatype: str = v.STRING
    lang: str | None = None


@dataclass(frozen=True)
class Pattern:
    store: QuadStore
    rows: DataFrame | None = None

    def _join(self, more: DataFrame, how: str = "inner") -> Pattern:
        if self.rows is None:
            return replace(self, rows=more)
        shared = [c for c in more.columns if c in self.rows.columns]
        if not shared:
            raise ValueError("a pattern must share a variable with those before it")
        return replace(self, rows=self.rows.join(more, shared, how))

    @staticmethod
    def _bind(rows: DataFrame, terms: list[tuple[str, object]]) -> DataFrame:
        names: dict[str, str] = {}
        for column, x in terms:
            if not is_var(x):
                rows = rows.where(F.col(column) == x)
            elif x[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[x[1:]]))
            else:
                names[x[1:]] = column
        return rows.select(*(F.col(c).alias(n) for n, c in names.items()))

    def triple(self, s: str, p: str, o: str, graph: str | None = None) -> Pattern:
        """Objects; a variable as ``p`` scans all predicates."""
        store = self.store.graph(graph) if graph else self.store
        rows = store.objs.select("s", "p", "o") if is_var(p) else store.pairs(p)
        return self._join(self._bind(rows, [("s", s), *([("p", p)] if is_var(p) else []), ("o", o)]))

    def data(self, s: str, p: str, value: object, as_number: bool = False, graph: str | None = None) -> Pattern:
        """Literals; a constant is compared by value, whatever its integer datatype."""
        store = self.store.graph(graph) if graph else self.store
        rows = store.values(p)
        if not is_var(value):
            lex = literal_lex(value)[0]
            same = F.col("num") == value if isinstance(value, (int, float)) and not isinstance(value, bool) else F.col("lex") == lex
            return self._join(self._bind(rows.where(same), [("s", s)]))
        return self._join(self._bind(rows, [("s", s), ("num" if as_number else "lex", value)]))

    def path(self, s: str, p: str, o: str) -> Pattern:
        """One or more steps of p; from or to a constant, only what it reaches is walked."""
        pairs, spark = self.store.pairs(p), self.store.objs.sparkSession
        if not is_var(o):
            rows = reachable(pairs, spark.createDataFrame([(o,)], "s string")).select("s", F.lit(o).alias("o"))
        elif not is_var(s):
            back = pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))
            rows = reachable(back, spark.createDataFrame([(s,)], "s string")).select(F.lit(s).alias("s"), F.col("s").alias("o"))
        else:
            rows = closure_pairs(pairs)
        return self._join(self._bind(rows, [("s", s), ("o", o)]))

    def filter(self, condition: Column) -> Pattern:
        return replace(self, rows=self.rows.where(condition))

    def extend(self, name: str, value: Column) -> Pattern:
        return replace(self, rows=self.rows.withColumn(name, value))

    def optional(self, other: Pattern) -> Pattern:
        return self._join(other.rows, "left")

    def minus(self, other: Pattern) -> Pattern:
        """Without the solutions that agree with one of the other; one that shares no variable takes nothing away."""
        if not set(self.rows.columns) & set(other.rows.columns):
            return self
        return self._join(other.rows, "left_anti")

    def exists(self, other: Pattern) -> Pattern:
        return self._join(other.rows, "left_semi")

    def union(self, other: Pattern) -> Pattern:
        return replace(self, rows=self.rows.unionByName(other.rows, allowMissingColumns=True))

    def select(self, *names: str, distinct: bool = False) -> DataFrame:
        out = self.rows.select(*names)
        return out.distinct() if distinct else out

    def group(self, keys: list[str], **aggregates: Column) -> DataFrame:
        return self.rows.groupBy(*keys).agg(*(x.alias(n) for n, x in aggregates.items()))


def update(store: QuadStore, where: DataFrame, delete: list[tuple] = (), insert: list[tuple] = (), graph: str = "default") -> QuadStore:
    """Delete and insert (s, p, o) templates, whose terms may be ``?column`` of ``where``.

    A template whose object is ``Literal`` writes or removes a literal. A term
    ``_:name`` in an insertion is a new blank node for each solution.
    """
    term = lambda x: F.col(x[1:]) if is_var(x) else F.concat(F.lit("_:"), F.hex(F.xxhash64(F.lit(x), *where.columns))) if str(x).startswith("_:") else F.lit(x)
    rows = lambda t: where.select(term(t[0]).alias("s"), term(t[1]).alias("p"), term(t[2]).alias("o")).distinct()

    def texts(t: tuple) -> DataFrame:
        lex, d = term(t[2].value).cast("string"), t[2].datatype
        return where.select(term(t[0]).alias("s"), term(t[1]).alias("p"), lex.alias("lex"), number(lex, F.lit(d)).alias("num"), F.lit(d).alias("d"), F.lit(t[2].lang).cast("string").alias("lang")).distinct()

    for t in delete:
        if isinstance(t[2], Literal):
            same = store.datas.join(texts(t).select("s", "p", "lex"), ["s", "p", "lex"], "left_anti")
            store = replace(store, datas=same.select(*store.datas.columns))
        else:
            store = replace(store, objs=store.objs.join(rows(t), ["s", "p", "o"], "left_anti").select("c", "s", "p", "o"))
    for t in insert:
        if isinstance(t[2], Literal):
            store = store.with_datas(texts(t).select(F.lit(graph).alias("c"), "*"))
        else:
            store = store.with_objs(rows(t).select(F.lit(graph).alias("c"), "s", "p", "o"))
    return store
