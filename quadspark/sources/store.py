"""The quad store: two DataFrames and views over them.

``objs`` holds (c, s, p, o), ``datas`` holds (c, s, p, lex, num, d, lang); ``c``
names the graph. A store is a value: every change makes another store whose
frames are plans over the old ones, until ``save`` writes a snapshot, partitioned
by predicate so that a pattern with a bound predicate reads its files only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.terms import QUAD_DATA, QUAD_OBJ

FORMAT_VERSION = 1


@dataclass(frozen=True)
class QuadStore:
    objs: DataFrame
    datas: DataFrame
    #: Property metadata, which is small: property -> its inverse, both ways.
    inverses: dict[str, str] = field(default_factory=dict)
    #: For a frame that is a union of single-predicate branches: kind -> (that frame, predicate -> branches, rows added of
    #: any predicate). A pattern with bound predicates is then built from their branches alone; it holds only while the
    #: frame is the same.
    parts: dict[str, tuple] = field(default_factory=dict)

    # ---- sources -------------------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession) -> QuadStore:
        return cls(spark.createDataFrame([], QUAD_OBJ), spark.createDataFrame([], QUAD_DATA))

    @classmethod
    def of_rows(cls, spark: SparkSession, objs: list[tuple] = (), datas: list[tuple] = (), **more) -> QuadStore:
        """From (c, s, p, o) and (c, s, p, lex, num, d, lang) tuples."""
        return cls(spark.createDataFrame(list(objs), QUAD_OBJ), spark.createDataFrame(list(datas), QUAD_DATA), **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        read = lambda kind, shape: spark.read.schema(shape).parquet(f"{path}/{kind}").select(*(x.split()[0] for x in shape.split(", ")))
        store = cls(read("objs", QUAD_OBJ), read("datas", QUAD_DATA))
        return replace(store, inverses=store.declared_inverses())

    def save(self, path: str, rows_a_file: int = 2_000_000) -> None:
        """A snapshot: one folder for each predicate, in as many files as its rows ask for, sorted by subject within files."""
        for kind, frame in (("objs", self.objs), ("datas", self.datas)):
            sizes = frame.groupBy("p").agg(F.ceil(F.count("*") / rows_a_file).cast("int").alias("files"))
            dealt = frame.join(F.broadcast(sizes), "p").repartition("p", F.pmod(F.xxhash64("s"), F.col("files")))  # a row for each predicate
            dealt.drop("files").sortWithinPartitions("p", "s").write.mode("overwrite").partitionBy("p").parquet(f"{path}/{kind}")

    def declared_inverses(self) -> dict[str, str]:
        rows = self.scan("objs", p=v.INVERSE_OF).where("NOT startswith(s, '_:') AND NOT startswith(o, '_:')").select("s", "o").collect()
        symmetric = self.scan("objs", p=v.TYPE, o=v.SYMMETRIC).select("s").collect()
        return {a: b for r in rows for a, b in ((r[0], r[1]), (r[1], r[0]))} | {r[0]: r[0] for r in symmetric}

    # ---- patterns ------------------------------------------------------------
    @property
    def quads(self) -> DataFrame:
        """Both kinds in one frame: o is null for literals, lex for objects."""
        lit = F.lit(None)
        objs = self.objs.select("c", "s", "p", "o", lit.cast("string").alias("lex"), lit.cast("double").alias("num"), lit.cast("string").alias("d"), lit.cast("string").alias("lang"))
        return objs.unionByName(self.datas.select("c", "s", "p", lit.cast("string").alias("o"), "lex", "num", "d", "lang"))

    def scan(self, kind: str = "quads", **bound: object) -> DataFrame:
        """Rows of ``objs``, ``datas`` or ``quads`` whose columns equal what is bound; None leaves a column free."""
        frame = getattr(self, kind)
        p = bound.get("p")
        if p is not None and kind == "quads":
            return replace(self, objs=self.scan("objs", p=p), datas=self.scan("datas", p=p)).scan("quads", **{k: x for k, x in bound.items() if k != "p"})
        if p is not None and kind in self.parts and self.parts[kind][0] is frame:
            _, branches, added = self.parts[kind]
            chosen = [f for x in dict.fromkeys([p] if isinstance(p, str) else p) for f in branches.get(x, ())] + list(added)
            frame = reduce(lambda a, b: a.unionByName(b), chosen) if chosen else frame.where("false")
        for name, value in bound.items():
            if value is not None:
                frame = frame.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
        return frame

    def has(self, kind: str = "quads", **bound: object) -> bool:
        return not self.scan(kind, **bound).isEmpty()

    def first(self, kind: str = "quads", **bound: object):
        return self.scan(kind, **bound).first()

    def pairs(self, p: str | list[str], inverse: str | None = None) -> DataFrame:
        """Distinct (s, o) through a property, in either direction where it has an inverse.

        Two unioned scans: never an OR in a join condition.
        """
        names = [p] if isinstance(p, str) else list(p)
        frame = self.scan("objs", p=names).select("s", "o")
        back = [i for i in ([inverse] if inverse else [self.inverses.get(x) for x in names]) if i]
        if not back:
            return frame
        return frame.unionByName(self.scan("objs", p=back).select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()

    def values(self, p: str | list[str]) -> DataFrame:
        return self.scan("datas", p=p)

    def predicates(self, s: str | None = None, o: str | None = None) -> DataFrame:
        """(p): the predicates of a subject, or of an object."""
        return (self.scan("objs", s=s, o=o) if o is not None else self.scan("quads", s=s)).select("p").distinct()

    def pattern(self, s: str | None = None, p: str | None = None, o: object = None) -> DataFrame:
        """Triples whose object is an IRI, or a literal written as (text, datatype or None, language or None)."""
        if isinstance(o, tuple):
            text, d, lang = (*o, None, None)[:3]
            return self.scan("datas", s=s, p=p, lex=text, d=d, lang=lang)
        return self.scan("objs", s=s, p=p, o=o) if o is not None else self.scan("quads", s=s, p=p)

    def predicate_counts(self) -> DataFrame:
        return self.quads.groupBy("p").agg(F.count("*").alias("n"))

    def punned(self) -> DataFrame:
        """Entities that are both class and individual."""
        types = self.scan("objs", p=v.TYPE)
        return types.where(F.col("o") == v.CLASS).select("s").join(types.where(F.col("o") == v.INDIVIDUAL).select("s"), "s", "left_semi").distinct()

    # ---- graphs --------------------------------------------------------------
    def graphs(self) -> DataFrame:
        return self.quads.select("c").distinct()

    def graph(self, c: str) -> QuadStore:
        return replace(self, objs=self.scan("objs", c=c), datas=self.scan("datas", c=c))

    def entity(self, iri: str, default: str | None = None) -> str | None:
        """The IRI if any triple mentions it, else the default."""
        return iri if self.has(s=iri) or self.has("objs", o=iri) else default

    def replace_graph(self, c: str, new: QuadStore) -> QuadStore:
        """With one graph's content put in place of what it had."""
        old = self.without(F.col("c") == c).without(F.col("c") == c, "datas")
        named = lambda f: f.withColumn("c", F.lit(c)).select(*f.columns)
        return old.plus("objs", named(new.objs).distinct()).plus("datas", named(new.datas).distinct())

    def resources(self) -> DataFrame:
        """All IRIs in use, as ``iri``."""
        each = [self.quads.select(F.col(x).alias("iri")) for x in ("s", "p")] + [self.objs.select(F.col("o").alias("iri"))]
        return each[0].unionByName(each[1]).unionByName(each[2]).distinct()

    def plus(self, kind: str, rows: DataFrame) -> QuadStore:
        """With rows that are known to be new: nothing is compared, and patterns go on reading the branches of their predicates."""
        old = getattr(self, kind)
        frame = old.unionByName(rows)
        parts = dict(self.parts)
        if kind in parts and parts[kind][0] is old:
            parts[kind] = (frame, parts[kind][1], (*parts[kind][2], rows))
        return replace(self, **{kind: frame}, parts=parts)

    def _add(self, kind: str, rows: DataFrame) -> QuadStore:
        """Only the new rows are made distinct; of the old ones, those that equal a new one are looked for."""
        old, new = getattr(self, kind), rows.distinct()
        names = old.columns
        new = new.select(*names)
        same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
        known = old.alias("k").join(new.alias("n"), same("k", "n"), "left_semi")
        return self.plus(kind, new.alias("n").join(known.alias("k"), same("n", "k"), "left_anti").select(*names))

    def with_objs(self, rows: DataFrame) -> QuadStore:
        return self._add("objs", rows)

    def with_datas(self, rows: DataFrame) -> QuadStore:
        return self._add("datas", rows)

    def without(self, condition: Column, kind: str = "objs") -> QuadStore:
        return replace(self, **{kind: getattr(self, kind).where(~F.coalesce(condition, F.lit(False)))})

    def register(self) -> None:
        """SQL views ``quads``, ``objs`` and ``datas``."""
        for name in ("quads", "objs", "datas"):
            getattr(self, name).createOrReplaceTempView(name)
