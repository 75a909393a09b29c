"""Changes of a store: add, set, delete, rename, destroy with its cascade, undo, disjointness, lists."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.store import QuadStore
from .closure import checkpointed, metadata, sift, union_all
from .constructs import Expression, Named, Or, Property, Writer


def add(store: QuadStore, objs: DataFrame | None = None, datas: DataFrame | None = None) -> QuadStore:
    """Append without duplicates; rows with a null s, p, o or lex are an error of the caller and are refused."""
    for rows, keys in ((objs, ("s", "p", "o")), (datas, ("s", "p", "lex"))):
        if rows is not None and not rows.where(" OR ".join(f"{k} IS NULL" for k in keys)).isEmpty():
            raise ValueError("a triple has a null")
    store = store.with_objs(objs) if objs is not None else store
    return store.with_datas(datas) if datas is not None else store


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last write for each key: what setting one value after the other leaves."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def set_values(store: QuadStore, rows: DataFrame, kind: str = "objs") -> QuadStore:
    """Delete what (c, s, p) of ``rows`` hold, then add the rows."""
    kept = getattr(store, kind).join(rows.select("c", "s", "p").distinct(), ["c", "s", "p"], "left_anti")
    return replace(store, **{kind: kept.unionByName(rows).dropDuplicates()})


def delete(store: QuadStore, condition: Column, kind: str = "objs") -> QuadStore:
    return store.without(condition, kind)


def delete_rows(store: QuadStore, rows: DataFrame, kind: str = "objs") -> QuadStore:
    return replace(store, **{kind: getattr(store, kind).join(rows, rows.columns, "left_anti")})


def value_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) between two value sets (s, o)."""
    return old.join(new, ["s", "o"], "left_anti"), new.join(old, ["s", "o"], "left_anti")


def refactor(store: QuadStore, names: DataFrame | dict[str, str]) -> QuadStore:
    """Rename IRIs: a dict is replaced in place without a shuffle; a frame (old, new) is joined on each column."""
    if isinstance(names, dict):
        table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        swap = lambda f, cs: f.select(*(F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)).alias(c) if c in cs else F.col(c) for c in f.columns))
    else:

        def swap(f: DataFrame, cs: tuple) -> DataFrame:
            for c in cs:
                f = f.join(names.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
            return f

    return replace(store, objs=swap(store.objs, ("s", "p", "o")).select("c", "s", "p", "o"), datas=swap(store.datas, ("s", "p")).select(*store.datas.columns))


@dataclass
class Removed:
    """What a destroy took away; adding it to the store again undoes it."""

    objs: DataFrame
    datas: DataFrame

    def undo(self, store: QuadStore) -> QuadStore:
        return store.with_objs(self.objs).with_datas(self.datas)


def doomed(store: QuadStore, seeds: DataFrame) -> DataFrame:
    """(s): the seeds and the blank nodes that fall with them, in either direction of construct links."""
    links = store.scan("objs", p=list(v.CONSTRUCT))
    owned = links.where(F.col("o").startswith("_:")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    owner = links.where(F.col("s").startswith("_:")).select(F.col("o").alias("a"), F.col("s").alias("b"))
    # Axioms fall with their source, property or target; a property has many, so these are looked at where it falls itself.
    noted = store.scan("objs", p=[v.SOURCE, v.TARGET]).select(F.col("o").alias("a"), F.col("s").alias("b"))
    used = store.scan("objs", p=v.PROPERTY).select(F.col("o").alias("a"), F.col("s").alias("b"))
    properties = checkpointed(used.select("a").distinct())
    edges = owned.unionByName(owner).unionByName(noted)
    # Links of named things are many, and met where these fall only, so they are read again; those that go on from blank nodes are written once.
    inner = checkpointed(edges.where(F.col("a").startswith("_:")))
    frontier = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("s")).distinct())
    found = [frontier]
    while True:
        at = frontier.select(F.col("s").alias("a"))
        onward = lambda f, at: sift(f, "a", at)[0].join(at, "a", "left_semi").select(F.col("b").alias("s"))
        new = onward(inner, at.where(F.col("a").startswith("_:")))
        if not (named := at.where(~F.col("a").startswith("_:"))).isEmpty():
            new = new.unionByName(onward(edges, named))
        fallen = checkpointed(properties.join(at, "a", "left_semi"))
        if not fallen.isEmpty():
            new = new.unionByName(used.join(metadata(fallen), "a", "left_semi").select(F.col("b").alias("s")))
        frontier = checkpointed(new.distinct().join(union_all(found), "s", "left_anti"))
        if frontier.isEmpty():
            return union_all(found)
        found.append(frontier)


def destroy(store: QuadStore, seeds: DataFrame) -> tuple[QuadStore, Removed]:
    """The store without the seeds, every triple that mentions them and their blank nodes; and what went."""
    gone = doomed(store, seeds)
    side = lambda c: gone.select(F.col("s").alias(c))
    # Triples are many for each predicate, so they are not joined by it with all that goes, but with what of that is a predicate.
    as_p = metadata(store.objs.select("p").unionByName(store.datas.select("p")).distinct().join(side("p"), "p", "left_semi"))
    # Few triples lead to what goes, so the others are not dealt by their objects; all are by their subjects, last, as joins on these go on from there.
    led, free = sift(store.objs.join(as_p, "p", "left_anti"), "o", gone)
    objs = free.unionByName(led.join(side("o"), "o", "left_anti").select(*free.columns)).join(side("s"), "s", "left_anti").select("c", "s", "p", "o")
    datas = store.datas.join(as_p, "p", "left_anti").join(side("s"), "s", "left_anti").select(*store.datas.columns)
    lost = store.objs.join(side("s"), "s", "left_semi").unionByName(sift(store.objs, "o", gone)[0].join(side("o"), "o", "left_semi").select(*store.objs.columns)).unionByName(store.objs.join(as_p, "p", "left_semi"))
    lost_datas = store.datas.join(side("s"), "s", "left_semi").unionByName(store.datas.join(as_p, "p", "left_semi"))
    return replace(store, objs=objs, datas=datas), Removed(lost.select("c", "s", "p", "o").distinct(), lost_datas.select(*store.datas.columns).distinct())


def destroy_graph(store: QuadStore, c: str) -> QuadStore:
    return store.without(F.col("c") == c).without(F.col("c") == c, "datas")


def disjoint_rows(graph: str, members: list[str], kind: str = "classes", prefix: str = "dj") -> list[tuple]:
    """Two members give one triple, more give a node with a list."""
    pair = {"classes": v.DISJOINT_WITH, "properties": v.PROPERTY_DISJOINT, "individuals": v.DIFFERENT_FROM}[kind]
    if len(members) == 2:
        return [(graph, members[0], pair, members[1])]
    w = Writer(graph, prefix)
    node = w.blank()
    w.objs.append((graph, node, v.TYPE, {"classes": v.ALL_DISJOINT_CLASSES, "properties": v.ALL_DISJOINT_PROPERTIES, "individuals": v.ALL_DIFFERENT}[kind]))
    w.objs.append((graph, node, v.DISTINCT_MEMBERS if kind == "individuals" else v.MEMBERS, w.list_of(members)))
    return w.objs


def list_rows(items: DataFrame, graph: str) -> DataFrame:
    """objs of RDF lists from (lst, pos, item), positions from 1; an empty list has no rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("lst").orderBy("pos")
    cell = F.when(F.col("pos") == F.min("pos").over(Window.partitionBy("lst")), F.col("lst")).otherwise(F.concat(F.lit("_:"), F.hex(F.xxhash64("lst", "pos"))))
    placed = items.withColumn("cell", cell).withColumn("next", F.lead("cell").over(w))
    both = F.array(F.struct(F.lit(v.FIRST).alias("p"), F.col("item").alias("o")), F.struct(F.lit(v.REST).alias("p"), F.coalesce("next", F.lit(v.NIL)).alias("o")))
    return placed.select(F.lit(graph).alias("c"), F.col("cell").alias("s"), F.explode(both).alias("t")).select("c", "s", "t.p", "t.o")


def declare(spark: SparkSession, graph: str, kind: str, names: list[str], above: str | None = None) -> DataFrame:
    """objs that create classes or properties (``class``, ``object``, ``data``, ``annotation``), beneath ``above`` if given."""
    kinds = {"class": v.CLASS, "object": v.OBJECT_PROPERTY, "data": v.DATA_PROPERTY, "annotation": v.ANNOTATION_PROPERTY}
    rows = [(graph, n, v.TYPE, kinds[kind]) for n in names]
    rows += [(graph, n, v.SUBCLASS if kind == "class" else v.SUBPROPERTY, above) for n in names] if above else []
    return spark.createDataFrame(rows, "c string, s string, p string, o string")


def disjoint_union_rows(graph: str, cls: str, members: list[str], prefix: str = "du") -> list[tuple]:
    """objs that make a class the disjoint union of others: its members beneath it, and apart from each other."""
    w = Writer(graph, prefix)
    w.objs.append((graph, cls, v.DISJOINT_UNION, w.list_of(members)))
    return [*w.objs, *((graph, m, v.SUBCLASS, cls) for m in members), *disjoint_rows(graph, members, prefix=prefix + "x")]


def set_class_values(store: QuadStore, cls: str, p: str, values: list, kind: str = "some", graph: str = "default", defined: bool = False, prefix: str = "cv") -> QuadStore:
    """A class's values of a property, as restrictions in place of those of that kind that it has.

    ``some`` writes one for each value, ``only`` one over their union; individuals
    and literals are ``value`` restrictions. ``defined`` makes them definitions.
    """
    spark, link = store.objs.sparkSession, v.EQUIVALENT_CLASS if defined else v.SUBCLASS
    picked = {"some": v.SOME, "only": v.ONLY, "value": v.VALUE}[kind]
    mine = store.scan("objs", s=cls, p=link).where("startswith(o, '_:')").select(F.col("o").alias("s"))
    on = store.scan("objs", p=v.ON_PROPERTY, o=p).select("s")
    old = mine.join(on, "s", "left_semi").join(store.scan("quads", p=picked).select("s"), "s", "left_semi")
    store, _ = destroy(store, checkpointed(old))
    w, named = Writer(graph, f"{prefix}{zlib.crc32(f'{cls} {p} {kind}'.encode())}n"), Property(p)
    of = lambda x: x if isinstance(x, Expression) else Named(x)
    if kind == "only":
        made = [named.only(of(values[0]) if len(values) == 1 else Or(tuple(map(of, values))))] if values else []
    else:
        made = [named.some(of(x)) if kind == "some" else named.value(x) for x in values]
    w.objs += [(graph, cls, link, w.encode(x)) for x in made]
    new = QuadStore.of_rows(spark, w.objs, w.datas)
    return store.with_objs(new.objs).with_datas(new.datas)


def set_imports(store: QuadStore, ontology: str, imports: list[str]) -> QuadStore:
    """The ontologies that one imports, in place of those it did."""
    kept = store.without((F.col("s") == ontology) & (F.col("p") == v.IMPORTS))
    if not imports:
        return kept
    rows = store.objs.sparkSession.createDataFrame([(ontology, ontology, v.IMPORTS, x) for x in imports], "c string, s string, p string, o string")
    return kept.with_objs(rows)


def longest_iri(iris: DataFrame, column: str) -> DataFrame:
    """(iri): the longest IRI, of equals the last: what numbering goes on from."""
    return iris.agg(F.max_by(column, F.struct(F.length(column), F.col(column))).alias("iri"))


def next_number(iris: DataFrame, column: str) -> DataFrame:
    """(n): one more than the greatest number that ends an IRI; 1 where there is none."""
    n = F.regexp_extract(column, "([0-9]+)$", 1).try_cast("long")
    return iris.agg((F.coalesce(F.max(n), F.lit(0)) + 1).cast("long").alias("n"))


def individuals(spark: SparkSession, graph: str, cls: str, names: list[str]) -> DataFrame:
    rows = [(graph, n, v.TYPE, c) for n in names for c in (v.INDIVIDUAL, cls)]
    return spark.createDataFrame(rows, "c string, s string, p string, o string")
