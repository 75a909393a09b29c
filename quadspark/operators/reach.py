"""Which of many pairs lie above one another, without the closure of all pairs.

A hierarchy (s, o), s having parent o, is kept as a table with a row for each
node and one for each edge: nodes on a cycle share a name, each other node hangs
under one of its parents, and the trees so made are numbered by an Euler tour, so
that a node is beneath another of its tree where its number lies in the other's
interval. Edges that no tree holds begin at portals; a node knows the nearest
portal at or above it, and a portal where its edges enter other trees and which
portals come next. Of a large hierarchy the leaves, then what they leave as leaves, are
layers of edges beside the index: a pair is asked of the parents instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as v
from .closure import SCHEMA_EDGES, checkpointed, cyclic_parts, list_items, numbered, reachable, union_all

TARGET = ["portal", "root", "pre", "post"]


def _few_tours(nodes: list, edges: list[tuple]) -> list[tuple]:
    """What ``_tour`` gives, of a few edges."""
    down: dict = {}
    for s, o in edges:
        down.setdefault(o, []).append(s)
    out = []
    for root in set(nodes) - {s for s, _ in edges}:
        clock, entered, todo = 0, {}, [(root, False)]
        while todo:
            node, over = todo.pop()
            clock += 1
            if over:
                out.append((node, root, entered[node], clock))
            else:
                entered[node] = clock
                todo.append((node, True))
                todo += [(x, False) for x in down.get(node, ())]
    return out


def _few_nearest(nodes: list, edges: list[tuple], stops: set) -> list[tuple]:
    """What ``_nearest`` gives, of a few edges."""
    up, found = dict(edges), {x: x for x in stops}
    for node in nodes:
        way = []
        while node is not None and node not in found:
            way.append(node)
            node = up.get(node)
        found.update(dict.fromkeys(way, found.get(node)))
    return [(x, found[x]) for x in nodes]


def _tour(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, root, pre, post) of the forest ``tree`` (s, o): when a walk enters a node and when it leaves it.

    A walk is a list of 2 cells a node, whose places come from pointer doubling, so
    a chain of n nodes takes log2(2n) rounds. Brothers are numbered over range
    partitions: a parent of a third of all nodes fills no single task.
    """
    kind = nodes.schema["node"].dataType
    enter, leave = (lambda c: F.concat(F.lit("<"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit(">"), F.col(c).cast("string")))
    order = numbered(tree, "o", "s")
    later = order.select("o", (F.col("pos") - 1).alias("pos"), F.col("s").alias("brother"))
    after = order.join(later, ["o", "pos"], "left").select(F.col("s").alias("node"), F.col("o").alias("parent"), "brother")
    first = tree.groupBy(F.col("o").alias("node")).agg(F.min("s").alias("child"))
    down = nodes.join(first, "node", "left").select(enter("node").alias("s"), F.coalesce(enter("child"), leave("node")).alias("o"))
    back = nodes.join(after, "node", "left").select(leave("node").alias("s"), F.coalesce(enter("brother"), leave("parent"), F.lit(v.NIL)).alias("o"))
    walk = checkpointed(down.unionByName(back))
    tops = nodes.join(tree.select(F.col("s").alias("node")), "node", "left_anti").select(F.col("node").alias("lst"), enter("node").alias("node"))
    cells = list_items(walk.select("s", F.col("s").alias("o")), walk, tops)
    name = F.expr("substring(item, 2)").cast(kind).alias("node")
    return cells.groupBy(name).agg(F.min("lst").alias("root"), F.min("pos").alias("pre"), F.max("pos").alias("post"))


def _nearest(nodes: DataFrame, tree: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, stop): the nearest of ``stops`` (node) at or above each node in the forest, null for none; by pointer doubling."""
    up = tree.select(F.col("s").alias("node"), F.col("o").alias("up"))
    marked = nodes.join(stops.select("node", F.lit(True).alias("is_stop")), "node", "left").join(up, "node", "left")
    hop = checkpointed(marked.select("node", F.when(F.col("is_stop"), F.col("node")).otherwise(F.col("up")).alias("stop"), F.expr("is_stop IS NOT NULL OR up IS NULL").alias("done")))
    closed, going = hop.where("done"), hop.where("NOT done")
    while not going.isEmpty():
        known = closed.unionByName(going).select(F.col("node").alias("stop"), F.col("stop").alias("far"), F.col("done").alias("ended"))
        step = checkpointed(going.join(known, "stop").select("node", F.col("far").alias("stop"), F.col("ended").alias("done")))
        closed, going = closed.unionByName(step.where("done")), step.where("NOT done")
    return checkpointed(closed.select("node", "stop"))


def _listed(rows: DataFrame) -> list:
    return [tuple(r) if len(r) > 1 else r[0] for r in rows.collect()]


class Reach:
    """An index of a hierarchy: ``nodes`` (node, rep, root, pre, post, portal), ``entries`` (portal, node, root, pre), ``onward`` (portal, next).

    Nodes are named by ``rep``, the least of their cycle. All three have rows in
    proportion to nodes and edges, and a test of pairs is joins with them. They are of
    the nodes that stand in no layer; ``layers`` (s, o) are edges of leaves, the lowest first.
    """

    def __init__(self, nodes: DataFrame, tree: DataFrame, entries: DataFrame, onward: DataFrame, few: bool, layers: list[DataFrame] = ()):
        self.nodes, self.tree, self.entries, self.onward, self.few, self.layers = nodes, tree, entries, onward, few, list(layers)

    @classmethod
    def build(cls, edges: DataFrame, most: int = SCHEMA_EDGES) -> Reach:
        """Index (s, o); rows with a null are no edges. Repeated edges and cycles are allowed; an empty table gives an empty index.

        The trees of ``most`` edges or fewer are metadata and are numbered on the
        driver; both ways give the same index but for the order of brothers.
        """
        raw, size, layers = cls._peeled(edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct(), most)
        few = size <= most
        parts = checkpointed(cyclic_parts(raw, most))
        every = raw.select(F.col("s").alias("node")).unionByName(raw.select(F.col("o").alias("node"))).distinct()
        names = checkpointed(every.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("rep")))
        as_rep = lambda c: names.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
        named = raw.join(as_rep("s"), "s").join(as_rep("o"), "o").select(F.col("rs").alias("s"), F.col("ro").alias("o"))
        dag = checkpointed(named.where("s <> o").distinct())
        tree = checkpointed(dag.groupBy("s").agg(F.min("o").alias("o")))
        reps = checkpointed(names.select(F.col("rep").alias("node")).distinct())
        kind = raw.schema["s"].dataType.simpleString()
        if few:
            rows = _few_tours(_listed(reps), _listed(tree.select("s", "o")))
            spans = checkpointed(edges.sparkSession.createDataFrame(rows, f"node {kind}, root {kind}, pre bigint, post bigint"))
        else:
            spans = checkpointed(_tour(reps, tree))
        low = spans.select(F.col("node").alias("s"), F.col("root").alias("root_s"), F.col("pre").alias("pre_s"))
        high = spans.select(F.col("node").alias("o"), "root", "pre", "post")
        others = dag.join(tree, ["s", "o"], "left_anti").join(low, "s").join(high, "o")
        extra = checkpointed(others.where("NOT (root_s = root AND pre_s BETWEEN pre AND post)").select(F.col("s").alias("portal"), F.col("o").alias("node"), "root", "pre"))
        near = cls._stops(few, reps, tree, extra.select(F.col("portal").alias("node")).distinct()).withColumnRenamed("stop", "portal")
        nodes = checkpointed(names.join(spans.join(near, "node").withColumnRenamed("node", "rep"), "rep").select("node", "rep", "root", "pre", "post", "portal"))
        leads = extra.select("portal", "node").unionByName(tree.join(extra.select(F.col("portal").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("portal"), F.col("o").alias("node")))
        onward = checkpointed(leads.join(near.select("node", F.col("portal").alias("next")), "node").where("next IS NOT NULL").select("portal", "next").distinct())
        return cls(nodes, tree, extra, onward, few, layers)

    @staticmethod
    def _peeled(edges: DataFrame, most: int) -> tuple[DataFrame, int, list[DataFrame]]:
        """The edges left, their number, and layers of leaves' edges, taken off while more than ``most`` are left and each layer holds a third of them."""
        left, layers = checkpointed(edges), []
        size = left.count()
        while size > most:
            parents = left.where("s <> o").select(F.col("o").alias("s")).distinct()
            inner = checkpointed(left.join(parents, "s", "left_semi"))
            before, size = size, inner.count()
            if 3 * size > 2 * before:
                return left, before, layers
            layers.append(checkpointed(left.where("s <> o").join(parents, "s", "left_anti")))
            left = inner
        return left, size, layers

    @staticmethod
    def _stops(few: bool, reps: DataFrame, tree: DataFrame, stops: DataFrame) -> DataFrame:
        if not few:
            return _nearest(reps, tree, stops)
        kind = reps.schema["node"].dataType.simpleString()
        rows = _few_nearest(_listed(reps), _listed(tree.select("s", "o")), set(_listed(stops)))
        return checkpointed(reps.sparkSession.createDataFrame(rows, f"node {kind}, stop {kind}"))

    def holds(self, pairs: DataFrame) -> DataFrame:
        """(s, o): the distinct pairs of which s is o or lies beneath it.

        For a leaf its parents are asked, a layer at a time; different leaves' same
        questions become one, and answers are joined back.
        """
        now, climbed = pairs.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct(), []
        for layer in self.layers:
            up = F.when(F.col("s") == F.col("o"), F.col("s")).otherwise(F.coalesce("up", "s")).alias("up")
            climbed.append(checkpointed(now.join(layer.select("s", F.col("o").alias("up")), "s", "left").select("s", "o", up)))
            now = climbed[-1].select(F.col("up").alias("s"), "o").distinct()
        found = self._holds(now)
        for step in reversed(climbed):
            found = step.join(checkpointed(found).withColumnRenamed("s", "up"), ["up", "o"], "left_semi").select("s", "o").distinct()
        return found

    def _holds(self, asked: DataFrame) -> DataFrame:
        """``holds`` of distinct pairs that ask for no leaf.

        A pair in one tree is settled by its numbers. Of the others, those that
        ask for the same thing from the same portal are one question; questions are
        followed from portal to portal, each once, and answers are carried back.
        What is asked is read more than once, and so is written.
        """
        asked = checkpointed(asked)
        low = self.nodes.select(F.col("node").alias("s"), F.col("root").alias("root_s"), F.col("pre").alias("pre_s"), "portal")
        high = self.nodes.select(F.col("node").alias("o"), "root", "pre", "post")
        known = checkpointed(asked.join(low, "s").join(high, "o").withColumn("inside", F.expr("root_s = root AND pre_s BETWEEN pre AND post")))
        open_ = known.where("NOT inside AND portal IS NOT NULL")
        frontier = checkpointed(open_.select(*TARGET).distinct())
        seen, good = [frontier], []
        entries = self.entries.select("portal", "root", F.col("pre").alias("at"))
        while not frontier.isEmpty():
            hit = checkpointed(frontier.join(entries, ["portal", "root"]).where("at BETWEEN pre AND post").select(*TARGET).distinct())
            good.append(hit)
            step = frontier.join(hit, TARGET, "left_anti").join(self.onward, "portal").select(F.col("next").alias("portal"), *TARGET[1:]).distinct()
            frontier = checkpointed(step.join(union_all(seen), TARGET, "left_anti"))
            seen.append(frontier)
        out = asked.where("s = o").unionByName(known.where("inside").select("s", "o"))
        if good:
            every, new = checkpointed(union_all(seen)), checkpointed(union_all(good))
            good = [new]
            while not new.isEmpty():
                back = new.withColumnRenamed("portal", "next").join(self.onward, "next").select(*TARGET).distinct()
                new = checkpointed(back.join(every, TARGET, "left_semi").join(union_all(good), TARGET, "left_anti"))
                good.append(new)
            out = out.unionByName(open_.join(union_all(good), TARGET, "left_semi").select("s", "o"))
        return out.distinct()

    def _beneath(self, marked: DataFrame) -> DataFrame:
        """(node): what is one of ``marked`` (node), or beneath one in its tree.

        In the order of the walk a node is within a marked interval where the
        greatest end of those begun so far is not behind it. Running maxima come
        from range partitions and are carried over them, without rounds.
        """
        spans = self.nodes.where("node = rep").select("node", "root", "pre", "post").join(marked.select("node", F.lit(True).alias("is_marked")), "node", "left")
        spread = spans.select("node", "root", "pre", F.expr("CASE WHEN is_marked THEN post END").alias("end")).repartitionByRange("root", "pre")
        fixed = checkpointed(spread.withColumn("_part", F.spark_partition_id()))
        ends = fixed.groupBy("root", "_part").agg(F.max("end").alias("end"))
        before = ends.select("root", "_part", F.max("end").over(Window.partitionBy("root").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        so_far = F.max("end").over(Window.partitionBy("_part", "root").orderBy("pre"))
        return fixed.withColumn("so_far", so_far).join(before, ["root", "_part"]).where(F.greatest("so_far", "before") >= F.col("pre")).select("node")

    def implied_by(self, codes: DataFrame, others: DataFrame) -> DataFrame:
        """(s): the codes that are one of the others or beneath one; sets of any size, no pair of them is made.

        What is joined may hold every node, and its files are small beside its rows: it is merged, as broadcasts of it would fill the driver.
        """
        marked = self.nodes.join(others.select(F.col("s").alias("node")), "node", "left_semi").select(F.col("rep").alias("node")).distinct()
        under = checkpointed(self._beneath(marked))
        ways = self.onward.select(F.col("portal").alias("s"), F.col("next").alias("o"))
        portals = reachable(ways, self.entries.join(under, "node", "left_semi").select("portal"), True).select(F.col("s").alias("portal"))
        own = self.nodes.select(F.col("node").alias("s"), "rep", "portal")
        own = own if self.layers else own.join(codes.select("s").distinct(), "s", "left_semi")
        found = own.join(under.withColumnRenamed("node", "rep"), "rep", "left_semi").select("s").unionByName(own.join(portals, "portal", "left_semi").select("s"))
        every = [found, others.select("s")]
        for layer in reversed(self.layers):
            every = [checkpointed(union_all(every))]
            every.append(layer.join(every[0].select(F.col("s").alias("o")).hint("merge"), "o", "left_semi").select("s"))
        return codes.join(union_all(every).hint("merge"), "s", "left_semi")
