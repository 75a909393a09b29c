"""Difference of two graphs up to the names of blank nodes.

Blank nodes get labels from their surroundings: rounds of hashing what a node
says and what is said of it, so equal structures get equal labels. Hashing alone
tells trees apart, but not regular rings: two triangles look like one hexagon. So
in each connected part of blank nodes with a cycle, nodes of equal label are told
apart by individualisation: every candidate of the part's least cell is marked in
a copy of the part, all copies are refined together, and the copy of least
certificate stays, until no two nodes of a cycle share a label. Rows are then
compared with multiplicity, both ways.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.store import QuadStore
from .closure import checkpointed, components

#: Predicates that read the same in both directions.
SYMMETRIC = (v.EQUIVALENT_CLASS, v.EQUIVALENT_PROPERTY, v.DISJOINT_WITH, v.PROPERTY_DISJOINT, v.SAME_AS, v.DIFFERENT_FROM, v.INVERSE_OF)

#: Parts of no more links between blank nodes than this are told apart each within a task, in one pass over all of them.
FEW_LINKS = 64
_TOLD = pa.schema([("g", pa.int32()), ("n", pa.string()), ("h", pa.int64())])


def _rows(store: QuadStore) -> DataFrame:
    """(s, p, o): literals as text that holds datatype and language; symmetric triples with the lesser end first."""
    lit = F.concat_ws("\u0001", F.lit('"'), "lex", F.coalesce("d", F.lit("")), F.coalesce("lang", F.lit("")))
    rows = store.quads.select("s", "p", F.coalesce("o", lit).alias("o"))
    turn = F.col("p").isin(*SYMMETRIC) & ~F.startswith("s", F.lit("_:")) & ~F.startswith("o", F.lit("_:")) & (F.col("s") > F.col("o"))
    return rows.select(F.when(turn, F.col("o")).otherwise(F.col("s")).alias("s"), "p", F.when(turn, F.col("s")).otherwise(F.col("o")).alias("o"))


def _blank(x: str) -> Column:
    return F.startswith(x, F.lit("_:"))


def _refined(rows: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``labels`` (by, n, h) after rounds of hashing over ``rows`` (by, s, p, o), until no label splits any more."""
    known, before = labels.select("h").distinct().count(), 0
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
    while known > before:
        a, b = labels.select(*by, F.col("n").alias("s"), F.col("h").alias("hs")), labels.select(*by, F.col("n").alias("o"), F.col("h").alias("ho"))
        both = rows.join(a, [*by, "s"], "left").join(b, [*by, "o"], "left")
        out = both.where("hs IS NOT NULL").groupBy(*by, F.col("s").alias("n")).agg(total(F.lit("out"), "p", F.coalesce(F.col("ho").cast("string"), F.col("o"))).alias("x"))
        into = both.where("ho IS NOT NULL").groupBy(*by, F.col("o").alias("n")).agg(total(F.lit("in"), "p", F.coalesce(F.col("hs").cast("string"), F.col("s"))).alias("y"))
        joined = labels.join(out, [*by, "n"], "left").join(into, [*by, "n"], "left")
        labels = checkpointed(joined.select(*by, "n", F.xxhash64("h", F.coalesce("x", zero), F.coalesce("y", zero)).alias("h")))
        known, before = labels.select("h").distinct().count(), known
    return labels


def _cyclic_nodes(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(g, n, part, core) of the parts with a cycle of blank nodes and two nodes of equal label; ``core`` leaves trees on the cycles out."""
    ends = rows.where(_blank("s") & _blank("o") & (F.col("s") != F.col("o")))
    edges = checkpointed(ends.select("g", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct())
    full = lambda c: F.concat_ws(" ", "g", c)
    parts = components(edges.select(full("a").alias("s"), full("b").alias("o"))).select(F.col("node").alias("full"), F.col("component").alias("part"))
    nodes = checkpointed(labels.select("g", "n", "h", full("n").alias("full")).join(parts, "full").select("g", "n", "h", "part"))
    counts = nodes.groupBy("part").agg(F.count("*").alias("nodes"), F.countDistinct("h").alias("labels"))
    links = edges.join(nodes.select("g", F.col("n").alias("a"), "part"), ["g", "a"])
    wanted = links.groupBy("part").agg(F.count("*").alias("edges")).join(counts, "part").where("edges >= nodes AND labels < nodes").select("part")
    tied = checkpointed(nodes.join(wanted, "part", "left_semi").select("g", "n", "part"))
    if tied.isEmpty():
        return None
    left, size, before = checkpointed(links.join(wanted, "part", "left_semi").select("g", "a", "b")), -1, -2
    while size != before:  # ends of trees go, one from each branch a round
        degree = left.select("g", F.explode(F.array("a", "b")).alias("n")).groupBy("g", "n").count()
        inner = degree.where("count > 1").select("g", "n")
        left = checkpointed(left.join(inner.withColumnRenamed("n", "a"), ["g", "a"], "left_semi").join(inner.withColumnRenamed("n", "b"), ["g", "b"], "left_semi"))
        size, before = left.count(), size
    core = left.select("g", F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("core", F.lit(True))
    return checkpointed(tied.join(core, ["g", "n"], "left").withColumn("core", F.coalesce("core", F.lit(False))))


def _told_apart(nodes: list[str], h: list[int], core: list[bool], ends: list[tuple[str, str, int]]) -> list[int]:
    """Labels of a small part's nodes, those of its core told apart; ``ends`` has (s, o, hash of p)."""
    at = {n: i for i, n in enumerate(nodes)}
    links = [(at[s], at[o], k) for s, o, k in ends]

    def refined(h: list[int]) -> list[int]:
        known, before = len(set(h)), 0
        while known > before:
            around: list[list] = [[] for _ in h]
            for s, o, k in links:
                around[s].append((k, 0, h[o]))
                around[o].append((k, 1, h[s]))
            h = [hash((x, *sorted(y))) for x, y in zip(h, around, strict=True)]  # of whole numbers only, so the same in all processes
            known, before = len(set(h)), known
        return h

    while tied := [(n, x) for x, n in Counter(x for x, c in zip(h, core, strict=True) if c).items() if n > 1]:
        cell = min(tied)[1]
        marked = ([hash((x, 1)) if i == j else x for j, x in enumerate(h)] for i, y in enumerate(h) if core[i] and y == cell)
        h = min(map(refined, marked), key=sorted)
    return h


def _each_told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "h", "core", "s", "o", "k")), strict=True):
            rows += [(r[0], n, x) for n, x in zip(r[1], _told_apart(*r[1:4], list(zip(*r[4:], strict=True))), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or ((), (), ()), _TOLD, strict=True)], schema=_TOLD)


def _small_parts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, n, h) of parts of a few ``links`` (g, part, s, o, k); ``nodes`` (g, n, h, part, core)."""
    by = ["g", "part"]
    ways = links.groupBy(*by).agg(F.collect_list(F.struct("s", "o", "k")).alias("e"))
    cells = nodes.groupBy(*by).agg(F.collect_list(F.struct("n", "h", "core")).alias("c"))
    parts = cells.join(ways, by).select("g", "c.n", "c.h", "c.core", "e.s", "e.o", "e.k")
    return checkpointed(parts.mapInArrow(_each_told_apart, "g int, n string, h long"))


def _individualised(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (g, n, h) with the nodes on cycles told apart within their parts."""
    nodes = _cyclic_nodes(rows, labels)
    if nodes is None:
        return labels
    # What is said with other nodes is in the labels already: nodes that share one agree in it.
    inside = rows.where(_blank("s") & _blank("o")).join(nodes.select("g", F.col("n").alias("s"), "part"), ["g", "s"])
    inside = checkpointed(inside.select("g", "part", "s", "p", "o", F.xxhash64("p").alias("k")))
    now = checkpointed(labels.join(nodes, ["g", "n"]).select("g", "n", "h", "part", "core"))
    by = ["g", "part", "branch"]
    few = checkpointed(inside.groupBy("g", "part").agg(F.count("*").alias("k")).where(F.col("k") <= FEW_LINKS).select("g", "part"))
    among = lambda f, how: f.join(few, ["g", "part"], how)
    told = _small_parts(among(inside.drop("p"), "left_semi"), among(now, "left_semi"))
    inside, now = checkpointed(among(inside.drop("k"), "left_anti")), checkpointed(among(now, "left_anti"))
    while True:
        cells = now.where("core").groupBy("g", "part", "h").count().where("count > 1")
        least = checkpointed(cells.groupBy("g", "part").agg(F.min(F.struct("count", "h")).alias("cell")).select("g", "part", "cell.h"))
        if least.isEmpty():
            break
        branches = checkpointed(now.where("core").join(least, ["g", "part", "h"]).select("g", "part", F.col("n").alias("branch")))
        marked = now.join(branches, ["g", "part"]).select(*by, "n", F.when(F.col("n") == F.col("branch"), F.xxhash64("h", F.lit("picked"))).otherwise(F.col("h")).alias("h"))
        tried = _refined(inside.join(branches, ["g", "part"]), checkpointed(marked), by)
        certificate = tried.groupBy(*by).agg(F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("c"))
        best = certificate.groupBy("g", "part").agg(F.min(F.struct("c", "branch")).alias("b")).select("g", "part", "b.branch")
        chosen = tried.join(best, by, "left_semi").select("g", "n", F.col("h").alias("new"))
        now = checkpointed(now.join(chosen, ["g", "n"], "left").select("g", "n", F.coalesce("new", "h").alias("h"), "part", "core"))
    now = now.select("g", "n", "h").unionByName(told)
    return labels.join(now.select("g", "n", F.col("h").alias("new")), ["g", "n"], "left").select("g", "n", F.coalesce("new", "h").alias("h"))


def canonical(*stores: QuadStore) -> list[DataFrame]:
    """(s, p, o) of each store with blank nodes named by their surroundings.

    The stores are labelled together, so that equal structures in them get equal
    names. A chain of n blank nodes may take n rounds. Graphs that differ never
    come out equal, but for a collision of 64-bit hashes. Equal graphs come out
    equal where, of nodes that hashing cannot tell apart in a part, marking either
    leads to copies that are alike or have different certificates: so for all but
    contrived regular graphs. A part of m nodes whose least cell has k costs k x m
    rows a round; trees, and trees that hang on cycles, are not copied for
    themselves. Parts of at most FEW_LINKS links take no rounds and no copies in
    tables: each is told apart within a task.
    """
    tagged = [_rows(store).withColumn("g", F.lit(i)) for i, store in enumerate(stores)]
    rows = checkpointed(functools.reduce(DataFrame.unionByName, tagged))
    each = lambda frame: [frame.where(F.col("g") == i).select("s", "p", "o") for i in range(len(stores))]
    nodes = rows.select("g", "s").unionByName(rows.select("g", F.col("o").alias("s"))).where(_blank("s")).distinct()
    if nodes.isEmpty():
        return each(rows)
    labels = _refined(rows, nodes.select("g", F.col("s").alias("n"), F.lit(0).cast("long").alias("h")), ["g"])
    labels = _individualised(rows, labels)
    name = lambda c: F.coalesce(F.concat(F.lit("_:"), F.hex(F.col("h"))), F.col(c))
    out = rows.join(labels.withColumnRenamed("n", "s"), ["g", "s"], "left").select("g", name("s").alias("s"), "p", "o")
    return each(out.join(labels.withColumnRenamed("n", "o"), ["g", "o"], "left").select("g", "s", "p", name("o").alias("o")))


def diff(old: QuadStore, new: QuadStore) -> DataFrame:
    """(side, s, p, o): rows that only one of the graphs has."""
    return diff_rows(*canonical(old, new))


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    gone, come = a.exceptAll(b), b.exceptAll(a)
    return gone.select(F.lit("removed").alias("side"), "*").unionByName(come.select(F.lit("added").alias("side"), "*"))
