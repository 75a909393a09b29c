"""Graph closures as joins: reachability from seeds, all pairs, components, lists.

Every loop cuts its lineage with checkpoint() into the session's checkpoint
folder and ends when a round finds nothing new, so cycles are safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as v

#: A hierarchy of no more edges than this is metadata and is walked on the driver; no more pairs than this are listed there.
SCHEMA_EDGES, SCHEMA_PAIRS = 50_000, 500_000

#: Bits of a sieve; 64 of them are a row, so that a sieve broadcasts a million rows at most.
SIEVE_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where spark.checkpoint.dir is unset, a session in one process may use a folder
    of its own; on a cluster it is an error, as no folder that all machines share
    is known.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; partitions and the order in them stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read back: a plan of one scan, of the size of its files.

    ``pinned`` would keep the size that was estimated for the plan it cuts off. An
    estimate of a join is a product, so in a loop its digits multiply with each
    round, until they fill the driver; and its rows are not compressed.
    """
    return stored(df, "step")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder, for readers of a few of its columns."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def metadata(rows: DataFrame, most: int = SCHEMA_EDGES) -> DataFrame:
    """``rows`` written once, and broadcast where they are no more than ``most``.

    Facts joined with axioms by predicate or class have a few hot keys; sent to
    the facts, axioms leave these spread as they are.
    """
    kept = checkpointed(rows)
    return F.broadcast(kept) if kept.count() <= most else kept


def sift(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` can be in the first column of ``keys``, and those for which it cannot.

    A broadcast bit for each hash of a key tells rows apart where they are, so that
    a join with keys too many to broadcast moves those few rows only that it may
    be about. Of n keys some n / SIEVE_BITS of the other rows pass for one.
    """
    at = lambda c: F.pmod(F.xxhash64(F.lit("sieve"), c), F.lit(SIEVE_BITS))
    words = keys.select(at(keys.columns[0]).alias("_at")).selectExpr("_at div 64 AS _word", "cast(_at % 64 AS int) AS _bit")
    words = checkpointed(words.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask")))
    met = rows.withColumn("_at", at(column)).join(F.broadcast(words), F.expr("_at div 64") == F.col("_word"), "left")
    hit = F.coalesce(F.expr("getbit(_mask, _at % 64) = 1"), F.lit(False))
    return met.where(hit).select(*rows.columns), met.where(~hit).select(*rows.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``pos``, their place from 1 in the order of columns.

    Ranks come from range partitions and running totals over them, so the
    global order takes no single task.
    """
    spread = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    fixed = checkpointed(spread)
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return fixed.withColumn("_rank", rank).join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_rank")).alias("pos"))


def code(name: Column | str, seed: int) -> Column:
    """The number that stands for a name; null stands for null, which no join meets."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.isNotNull(), F.xxhash64(F.lit(seed), name))


def coded(names: DataFrame, most_seeds: int = 8) -> tuple[DataFrame, int]:
    """(id, name) of the distinct names in the first column, and the seed for which all their numbers differ."""
    names = names.select(F.col(names.columns[0]).alias("name")).distinct()
    for seed in range(most_seeds):
        made = checkpointed(names.select(code("name", seed).alias("id"), "name"))
        if made.groupBy("id").count().where("count > 1").isEmpty():
            return made, seed
        names = made.select("name")
    raise RuntimeError("names share their numbers")


def with_names(rows: DataFrame, *names: DataFrame) -> DataFrame:
    """``rows`` with names for numbers, from one frame (id, name) for all columns or one for each; those with a number that is not there go."""
    for i, c in enumerate(rows.columns):
        own = names[min(i, len(names) - 1)].select(F.col("id").alias("_id"), F.col("name").alias("_name"))
        rows = rows.join(own, F.col(c).eqNullSafe(F.col("_id"))).withColumn(c, F.col("_name")).drop("_id", "_name")
    return rows


def reachable(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False) -> DataFrame:
    """(s, depth): nodes that reach a seed along edges (s, o), with the least number of steps.

    Semi-naive: each round joins the last round's new nodes with the edges, and
    is written once. A seed appears with depth 0 when asked for, else only if it
    lies on a cycle.
    """
    links = checkpointed(edges.select("s", "o").distinct())
    frontier = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("s")).distinct())
    found = [frontier.select("s", F.lit(0).alias("depth"))] if include_seeds else []
    depth = 0
    while True:
        depth += 1
        step = links.join(frontier.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()
        if found:
            step = step.join(union_all(found).select("s"), "s", "left_anti")
        frontier = checkpointed(step)
        if frontier.isEmpty():
            break
        found.append(frontier.select("s", F.lit(depth).alias("depth")))
    return union_all(found) if found else links.limit(0).select("s", F.lit(0).alias("depth"))


def closure_pairs(edges: DataFrame) -> DataFrame:
    """All (s, o) with a path from s to o, by doubling the path length in each round.

    A pair whose shortest path has more than half of the length reached begins
    with one that the round before has found, so only that round's pairs are joined.
    """
    new = checkpointed(edges.select("s", "o").distinct())
    found = [new]
    while not new.isEmpty():
        onward = union_all([f.select(F.col("s").alias("mid"), F.col("o").alias("to")) for f in found])
        more = new.select(F.col("s").alias("from"), F.col("o").alias("mid")).join(onward, "mid").select(F.col("from").alias("s"), F.col("to").alias("o")).distinct()
        new = checkpointed(more.join(union_all(found), ["s", "o"], "left_anti"))
        found.append(new)
    return union_all(found)


def _few_parts(edges: list[tuple]) -> list[tuple]:
    """(node, part) of a few edges: nodes in the order in which walks end, then walks backwards from the last."""
    down: dict = {}
    up: dict = {}
    for s, o in edges:
        down.setdefault(s, []).append(o)
        up.setdefault(o, []).append(s)
    ended, seen = [], set()
    for start in down:
        todo = [] if start in seen else [(start, iter(down[start]))]
        seen.add(start)
        while todo:
            node, onward = todo[-1]
            after = next((x for x in onward if x not in seen), None)
            if after is None:
                ended.append(node)
                todo.pop()
            else:
                seen.add(after)
                todo.append((after, iter(down.get(after, ()))))
    out, given = [], set()
    for start in reversed(ended):
        if start not in given:
            given.add(start)
            part, at = [start], 0
            while at < len(part):
                more = [x for x in dict.fromkeys(up.get(part[at], ())) if x not in given]
                given.update(more)
                part += more
                at += 1
            out += [(x, min(part)) for x in part] if len(part) > 1 else []
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that have no way in or no way out."""
    into, out = edges.select(F.col("o").alias("s")).distinct(), edges.select(F.col("s").alias("o")).distinct()
    return checkpointed(edges.join(into, "s", "left_semi").join(out, "o", "left_semi").select("s", "o"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Chains of nodes with one way in and one way out, each made one edge; None where there are none.

    Gives the edges that are left, (node, last): the nodes of chains and the last of
    each chain, (last, u, w): where a chain comes from and leads to, and (node,
    part): cycles of such nodes alone. Nodes learn the end of their chain by
    pointer doubling, so that n nodes take log2(n) rounds.
    """
    once = lambda c: edges.groupBy(c).agg(F.count("*").alias("k")).where("k = 1").select(F.col(c).alias("node"))
    mid = checkpointed(once("s").join(once("o"), "node", "left_semi"))
    if mid.isEmpty():
        return None
    onward = edges.join(mid.withColumnRenamed("node", "s"), "s", "left_semi")
    inner = onward.join(mid.withColumnRenamed("node", "o"), "o", "left_semi").select(F.col("s").alias("node"), F.col("o").alias("last"))
    going = checkpointed(inner.withColumn("least", F.least("node", "last")))
    ended = mid.join(going.select("node"), "node", "left_anti").select("node", F.col("node").alias("last"))
    done, left, moved = [checkpointed(ended)], going.count(), True
    while left and moved:
        known = union_all(done)
        hop = going.join(known.select(F.col("node").alias("last"), F.col("last").alias("end")), "last", "left").join(
            going.select(F.col("node").alias("last"), F.col("last").alias("far"), F.col("least").alias("least2")), "last", "left"
        )
        step = checkpointed(hop.select("node", F.coalesce("end", "far", "last").alias("last"), F.least("least", "least2").alias("less"), "least", F.col("end").isNotNull().alias("at_end")))
        done.append(step.where("at_end").select("node", "last"))
        # On a cycle the least name goes on shrinking until a node has seen all.
        moved = not step.where("at_end OR less < least").isEmpty()
        going = step.where("NOT at_end").select("node", "last", F.col("less").alias("least"))
        left = going.count()
    chains = checkpointed(union_all(done))
    entered = edges.join(mid.withColumnRenamed("node", "s"), "s", "left_anti").select(F.col("s").alias("u"), F.col("o").alias("node")).join(chains, "node").select("last", "u")
    ends = checkpointed(entered.join(edges.select(F.col("s").alias("last"), F.col("o").alias("w")), "last").select("last", "u", "w"))
    direct = edges.join(mid.withColumnRenamed("node", "s"), "s", "left_anti").join(mid.withColumnRenamed("node", "o"), "o", "left_anti").select("s", "o")
    rest = checkpointed(direct.unionByName(ends.select(F.col("u").alias("s"), F.col("w").alias("o"))).where("s <> o").distinct())
    return rest, chains, ends, going.select("node", F.col("least").alias("part"))


def _with_chains(parts: DataFrame, chains: DataFrame, ends: DataFrame) -> DataFrame:
    """``parts`` (node, part) with the nodes of those chains that begin and end in one part, or at one node."""
    at = lambda c, name: parts.select(F.col("node").alias(c), F.col("part").alias(name))
    seen = ends.join(at("u", "pu"), "u", "left").join(at("w", "pw"), "w", "left")
    inside = checkpointed(seen.where("pu = pw OR u = w").select("last", "u", F.coalesce("pu", "u").alias("part")))
    return checkpointed(parts.unionByName(inside.select(F.col("u").alias("node"), "part")).unionByName(chains.join(inside.select("last", "part"), "last").select("node", "part")).distinct())


def cyclic_parts(edges: DataFrame, most: int = SCHEMA_EDGES) -> DataFrame:
    """(node, part): nodes on cycles of (s, o), and the least node of their strongly connected part.

    Nodes without a way in or out are trimmed and chains contracted, by turns, as
    long as a tenth of the edges goes. Where ``most`` edges or fewer are left, they
    are metadata and are walked on the driver. Of more, each node learns the least
    node that reaches it; of the nodes with one such root, those that reach the
    root are its part. What is left goes through the same again, and chains then
    belong to the part that they begin and end in. The work is a few joins of the
    edges a round, not all pairs of a closure, and a chain takes rounds by the
    logarithm of its length.
    """
    kind = edges.schema["s"].dataType.simpleString()
    left = checkpointed(edges.select("s", "o").where("s <> o").distinct())
    parts: list[DataFrame] = []
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        size = left.count()
        while size > most:
            left = _trimmed(left)
            made = _contracted(left)
            if made:
                left, chains, ends, cycles = made
                levels.append((chains, ends))
                parts.append(cycles)
            before, size = size, left.count()
            if size > 0.9 * before:
                break
        if size <= most:
            if size:
                rows = _few_parts([tuple(r) for r in left.collect()])
                parts.append(edges.sparkSession.createDataFrame(rows, f"node {kind}, part {kind}"))
            break
        root = checkpointed(left.select(F.col("s").alias("n")).unionByName(left.select(F.col("o").alias("n"))).distinct().select("n", F.col("n").alias("r")))
        while True:  # the least node that reaches each
            from_before = left.join(root.select(F.col("n").alias("s"), "r"), "s").groupBy(F.col("o").alias("n")).agg(F.min("r").alias("m"))
            next_root = checkpointed(root.join(from_before, "n", "left").select("n", F.least("r", F.coalesce("m", "r")).alias("r"), (F.col("m") < F.col("r")).alias("moved")))
            root = next_root.select("n", "r")
            if next_root.where("moved").isEmpty():
                break
        same = left.join(root.select(F.col("n").alias("s"), "r"), "s").join(root.select(F.col("n").alias("o"), F.col("r").alias("ro")), "o").where("r = ro").select("s", "o")
        part = reachable(same, root.where("n = r").select("n"), True).select(F.col("s").alias("n")).join(root, "n").select(F.col("n").alias("node"), F.col("r").alias("part"))
        part = checkpointed(part)
        parts.append(part.join(part.groupBy("part").count().where("count > 1").select("part"), "part", "left_semi").select("node", "part"))
        gone = part.select(F.col("node").alias("s"))
        left = checkpointed(left.join(gone, "s", "left_anti").join(gone.select(F.col("s").alias("o")), "o", "left_anti").select("s", "o"))
    loops = edges.where("s = o").select(F.col("s").alias("node"), F.col("s").alias("part")).distinct()
    if not parts:
        return loops
    found = checkpointed(union_all(parts))
    for chains, ends in reversed(levels):
        found = _with_chains(found, chains, ends)
    if levels:  # a chain may have the least name
        found = found.join(found.groupBy("part").agg(F.min("node").alias("least")), "part").select("node", F.col("least").alias("part"))
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def fingerprint(rows: DataFrame) -> tuple:
    """(count, sums of hashes under two seeds) of the rows; sums are decimals, as one of whole numbers overflows at some millions of rows."""
    total = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
    return tuple(rows.agg(F.count("*"), total(*rows.columns), total(F.lit(1), *rows.columns)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph (s, o); a component has the name of its least node.

    Alternating large and small stars: grouped minima and joins only.
    """
    now = checkpointed(edges.select(F.col("s").alias("a"), F.col("o").alias("b")).where("a <> b").distinct())
    seen = fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if (after := fingerprint(now)) == seen:
            break
        seen = after
    root = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(root)


def multi_property(edge_sets: list[DataFrame], back: list[DataFrame] = ()) -> DataFrame:
    """Closure over several properties, some of them read backwards."""
    frames = [e.select("s", "o") for e in edge_sets] + [e.select(F.col("o").alias("s"), F.col("s").alias("o")) for e in back]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return closure_pairs(out)


class Hierarchy:
    """Classes or properties below and above others.

    Up to SCHEMA_EDGES edges are read once and walked on the driver, which is
    what makes a class criterion cheap; a larger hierarchy is closed with joins.
    """

    def __init__(self, edges: DataFrame):
        self.edges = edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct()
        rows = self.edges.limit(SCHEMA_EDGES + 1).collect()
        self.down: dict[str, list[str]] | None = {} if len(rows) <= SCHEMA_EDGES else None
        self.up: dict[str, list[str]] = {}
        if self.down is not None:
            for s, o in rows:
                self.down.setdefault(o, []).append(s)
                self.up.setdefault(s, []).append(o)

    @staticmethod
    def _walk(links: dict[str, list[str]], start: list[str]) -> set[str]:
        seen, todo = set(start), list(start)
        while todo:
            for x in links.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def names_below(self, names: list[str], most: int = 500) -> list[str] | None:
        """The names and all beneath them, where they are few enough to stand in a filter."""
        found = self._walk(self.down, names) if self.down is not None else None
        return sorted(found) if found is not None and len(found) <= most else None

    def below(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """(cls): the names and all beneath them."""
        if self.down is not None:
            return spark.createDataFrame([(x,) for x in sorted(self._walk(self.down, names))], "cls string")
        return reachable(self.edges, spark.createDataFrame([(x,) for x in names], "s string"), True).select(F.col("s").alias("cls"))

    def above(self, spark: SparkSession, names: list[str]) -> DataFrame:
        if self.down is not None:
            return spark.createDataFrame([(x,) for x in sorted(self._walk(self.up, names))], "cls string")
        flipped = self.edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return reachable(flipped, spark.createDataFrame([(x,) for x in names], "s string"), True).select(F.col("s").alias("cls"))

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(s, o): s is strictly below o."""
        rows: list[tuple[str, str]] = []
        for s in self.up if self.down is not None else ():
            rows += [(s, o) for o in self._walk(self.up, self.up[s])]
            if len(rows) > SCHEMA_PAIRS:
                break
        if self.down is None or len(rows) > SCHEMA_PAIRS:
            return closure_pairs(self.edges)
        return spark.createDataFrame(rows, "s string, o string")


_known: dict[tuple[int, str], tuple[DataFrame, Hierarchy]] = {}


def hierarchy(store, p: str) -> Hierarchy:
    """The hierarchy of a store's ``p``, read once for as long as the store's rows are the same frame."""
    at = (id(store.objs), p)
    if at not in _known or _known[at][0] is not store.objs:
        while len(_known) >= 8:
            _known.pop(next(iter(_known)))
        _known[at] = store.objs, Hierarchy(store.scan("objs", p=p))
    return _known[at][1]


def roots(edges: DataFrame) -> DataFrame:
    """(s): parents that have no parent themselves."""
    return edges.select(F.col("o").alias("s")).distinct().join(edges.select("s").distinct(), "s", "left_anti")


#: Cells that are linked with each other where they lie, at most.
CELLS = 1 << 18
_LINKED = "node long, s string, last long, far long, o string, open boolean, cyclic boolean, ended boolean, begin long, lst string, pos long, length long"


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (node, s, o) with the last cell that they lead to among those read together, and the list where that is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CELLS:
            yield from _link(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _link(pa.Table.from_batches(held))


def _link(cells: pa.Table) -> Iterator[pa.RecordBatch]:
    node, s, o = (cells.column(c).combine_chunks() for c in ("node", "s", "o"))
    nodes, n = node.to_numpy(), len(node)
    onward = pc.fill_null(pc.index_in(o, value_set=s), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    inner, nil = onward >= 0, pc.fill_null(pc.equal(o, v.NIL), False).to_numpy(zero_copy_only=False)
    last, far = np.where(inner, onward, np.arange(n)), inner.astype(np.int64)
    for _ in range(n.bit_length()):
        far, last = far + far[last], last[last]
    cyclic = inner[last]
    last = np.where(cyclic, np.arange(n), last)
    met = np.zeros(n, bool)
    met[onward[inner]] = True
    starts = np.flatnonzero(~met & ~cyclic)
    begin = np.full(n, -1)
    begin[last[starts]] = starts
    begin[np.bincount(last[starts], minlength=n) != 1] = -1  # of the last cell of each list
    begin = np.where(nil[last] & ~cyclic, begin[last], -1)
    none = begin < 0
    length = far[begin] + 1
    columns = [
        node, s, pa.array(nodes[last]), pa.array(far), pc.if_else(pa.array(inner), None, o), pa.array(~met), pa.array(cyclic), pa.array(nil[last] & ~cyclic),
        pa.array(nodes[begin], mask=none), s.take(pa.array(begin, mask=none)), pa.array(length - far, mask=none), pa.array(length, mask=none),
    ]
    yield from pa.table(columns, [c.split()[0] for c in _LINKED.split(", ")]).to_batches(max_chunksize=10_000)


def list_items(first: DataFrame | None, rest: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(lst, pos, item, length) of RDF lists: ``first`` (s, o), or None for the cells themselves, ``rest`` (s, o), ``heads`` (lst, node), by default all cells that no other goes on with.

    Cells are numbered as they are written, and those that lie together are linked
    with each other there, so that a list written as one takes no shuffle. What leads
    from one such stretch to another is joined by name: the last cells of stretches
    learn their list's last cell and the distance to it by pointer doubling, so a
    list of n stretches takes log2(n) rounds rather than n. A position is the
    difference of two distances, so no list is ever gathered in one task; ``length``
    is a list's number of cells. A chain that breaks off ends there; cells on a cycle
    or before one have no position and are left out. Different lists share no cell.
    """
    numbered = rest.select("s", "o").withColumn("node", F.monotonically_increasing_id()).select("node", "s", "o")
    cells = checkpointed(numbered.mapInArrow(_linked, _LINKED))
    going_on = cells.where(F.col("o") != v.NIL).select(F.col("o").alias("s"), F.col("node").alias("from"))
    names = cells.select("s", "node", "last", "far", "cyclic")
    into = sift(names, "s", going_on)[0]
    met = checkpointed(going_on.join(into, "s", "left").select(F.col("from").alias("node"), F.col("node").alias("met"), "last", (F.col("far") + 1).alias("far"), "cyclic"))
    entered = met.where("met IS NOT NULL").select("met")
    links = met.where("met IS NOT NULL AND NOT cyclic").select("node", "last", "far")
    broken = met.where("met IS NULL").select("node")
    ended = cells.where(F.col("o") == v.NIL).select("node").unionByName(broken)
    zero = F.lit(0).cast("long").alias("far")
    closed, going, found = ended.select("node", F.col("node").alias("last"), zero), links, [broken.select("node", F.col("node").alias("last"), zero)]
    left, before = links.count(), -1
    while left and left != before:  # the nearest end that is not done gets done in each round, unless all that are left run into cycles
        known = closed.withColumn("done", F.lit(True)).unionByName(going.withColumn("done", F.lit(False)))
        known = known.select(F.col("node").alias("last"), F.col("last").alias("last2"), F.col("far").alias("far2"), "done")
        step = checkpointed(going.join(known, "last").select("node", F.col("last2").alias("last"), (F.col("far") + F.col("far2")).alias("far"), "done"))
        found.append(step.where("done").drop("done"))
        closed, going = closed.unionByName(found[-1]), step.where("NOT done").drop("done")
        left, before = going.count(), left
    split = not entered.isEmpty()
    apart = cells.where("NOT cyclic")
    whole = None
    if heads is None:
        whole, apart = apart.where("begin IS NOT NULL"), apart.where("begin IS NULL")
        if split:  # what begins here may go on from elsewhere
            maybe, whole = sift(whole, "begin", entered)
            outside = entered.select(F.col("met").alias("begin"))
            whole = whole.unionByName(maybe.join(outside, "begin", "left_anti").select(*whole.columns))
            apart = apart.unionByName(maybe.join(outside, "begin", "left_semi").select(*whole.columns))
    ends = union_all(found).select(F.col("node").alias("last"), F.col("last").alias("end"), F.col("far").alias("more"))
    placed = apart.where("ended").select("node", "s", "open", "last", "far").unionByName(
        apart.where("NOT ended").join(ends, "last").select("node", "s", "open", F.col("end").alias("last"), (F.col("far") + F.col("more")).alias("far"))
    )
    if heads is None:
        starts = placed.where("open").join(entered.select(F.col("met").alias("node")), "node", "left_anti").select(F.col("s").alias("lst"), "last", F.col("far").alias("total"))
    else:
        starts = placed.join(heads.select("lst", F.col("node").alias("s")), "s").select("lst", "last", F.col("far").alias("total"))
    rows = starts.join(placed, "last").where("far <= total").select("lst", (F.col("total") - F.col("far") + 1).alias("pos"), "s", (F.col("total") + 1).alias("length"))
    if whole is not None:
        rows = whole.select("lst", "pos", "s", "length").unionByName(rows)
    if first is None:
        return rows.select("lst", "pos", F.col("s").alias("item"), "length")
    return rows.join(first.select("s", F.col("o").alias("item")), "s").select("lst", "pos", "item", "length")
