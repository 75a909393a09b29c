"""The prefix trie of conversations, from mergeable partial tries.

A node is a distinct sequence of first turns (role, text); the root is the empty
one. Its key is its depth and two 64-bit sums over its turns, each term mixed from
the 128-bit digest of the turn and its place; sums of parts add up, so a long
conversation can be read in parts. Only digests and lengths are shuffled.

1. Turns are dealt and sorted by ranges of (block, conversation, turn, digest,
   row): a conversation with any share of the rows lies in several partitions. A
   row a partition says what the next one has to know: the conversation it is in,
   turns and sums so far, and the first turns of the block's base.
2. Each partition emits the nodes of its turns and the ends of its conversations,
   combined locally in runs of LOCAL_ROWS: a partial trie.
3. Partial tries meet by key in rounds: groups of FAN partitions, groups of FAN
   groups, and so on, members summed and least members kept. Lists of ends are
   kept by ranges of ENDS ids, so that no cell grows with a node; a node's digest
   runs over its ranges in order, a batch at a time (SHA-256 cannot be merged, so
   it is one stream for a node, of ids only).
4. Bottom-up rollup: each node has the member of least mixed id, and the nodes of
   one such member form a path. A path hangs under another's node, and from a node
   down to any leaf paths change only where a set of members loses its least mixed
   id, some ln(members) times at the most expected. So sums move up a path a round,
   in logarithmically many rounds, and inside a path by running sums over stretches
   of STRETCH nodes.

Defined results: null roles and texts are empty; rows without a conversation
belong to none; null turns come first; equal turns are ordered by the MD5 of
role and text, and equal rows are turns each; an empty table has no nodes; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import stored
from .common import blocks_for, checkpointed, load, mix64, odd_constants

FAN, ENDS, STRETCH, LOCAL_ROWS, ROWS_A_PART = 32, 16, 1_024, 100_000, 250_000
KEY = ["depth", "k1", "k2"]
NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, path long, chars long"
PARTIAL = f"part int, {NODE}, bucket long, ends array<long>"
C1, C2, C3 = odd_constants(3, 12)
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % 6


class Walk:
    """Goes through sorted turns; ``state`` is what has to be known of the rows before."""

    def __init__(self, state: dict, shared: Callable[[int], int], most: int):
        self.state, self.shared, self.most = dict(state), shared, most
        self.nodes: list[list[np.ndarray]] = []
        self.ends: list[tuple[int, int, int, int]] = []

    def _open(self, conv: int, block: int) -> None:
        s = self.state
        if block != s["block"] or s["conv"] is None:
            s["block"], s["heads"] = block, []
        wanted = 0 if conv == block else self.shared(conv)
        k = min(wanted, len(s["heads"]))
        lanes = [(0, 0)]
        for d, (h1, h2, _) in enumerate(s["heads"][:k], 1):
            x1, x2 = turn_terms(np.array([h1], np.int64), np.array([h2], np.int64), np.array([d]))
            lanes.append(((lanes[-1][0] + int(x1[0])) % (1 << 64), (lanes[-1][1] + int(x2[0])) % (1 << 64)))
        s |= {"conv": conv, "seen": 0, "wanted": wanted, "k": k, "lanes": lanes[-1]}
        at = np.array(lanes, np.uint64)
        up = np.concatenate([at[:1], at[:-1]])
        chars = np.array([0, *(c for _, _, c in s["heads"][:k])], np.int64)
        self.nodes.append([np.arange(k + 1), at[:, 0], at[:, 1], up[:, 0], up[:, 1], np.full(k + 1, conv), chars])

    def close(self) -> None:
        """The conversation so far has no more turns."""
        s = self.state
        if s["conv"] is not None:
            self.ends.append((s["k"] + max(0, s["seen"] - s["wanted"]), *s["lanes"], s["conv"]))

    def turns(self, batch: pa.RecordBatch) -> None:
        block, conv, h1, h2, chars = (batch.column(c).to_numpy() for c in ("block", "conv_id", "h1", "h2", "chars"))
        n, s = len(conv), self.state
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        stops = np.append(starts[1:], n)
        of_run, ended = [], []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            c = int(conv[a])
            if s["conv"] is None or c != s["conv"]:
                if a:
                    ended.append((a - 1, s["k"] + max(0, s["seen"] - s["wanted"]), s["conv"]))
                else:
                    self.close()
                self._open(c, int(block[a]))
            seen = s["seen"]
            if c == s["block"]:
                some = slice(a, min(b, a + self.most - len(s["heads"])))
                s["heads"] = s["heads"] + list(zip(h1[some].tolist(), h2[some].tolist(), chars[some].tolist(), strict=True))
            of_run.append((seen, s["wanted"], s["k"], *s["lanes"]))
            s["seen"] = seen + b - a
        runs = np.repeat(np.array([r[:3] for r in of_run], np.int64), stops - starts, axis=0)
        first = np.repeat(np.array([r[3:] for r in of_run], np.uint64), stops - starts, axis=0)
        own = runs[:, 0] + np.arange(n) - np.repeat(starts, stops - starts)
        depth, new = own - runs[:, 1] + runs[:, 2] + 1, own >= runs[:, 1]
        out = []
        for lane, terms in enumerate(turn_terms(h1, h2, depth)):
            terms = np.where(new, terms, np.uint64(0))
            total = np.cumsum(terms, dtype=np.uint64)
            before = np.repeat(np.concatenate([[np.uint64(0)], total])[starts], stops - starts)
            at = first[:, lane] + (total - before)
            out.append((at, at - terms))
        self.ends += [(d, int(out[0][0][i]), int(out[1][0][i]), c) for i, d, c in ended]
        s["lanes"] = (int(out[0][0][-1]), int(out[1][0][-1]))
        self.nodes.append([x[new] for x in (depth, out[0][0], out[1][0], out[0][1], out[1][1], conv, chars)])

    def rows(self) -> int:
        return sum(len(x[0]) for x in self.nodes)

    def taken(self, part: int) -> Iterator[pa.RecordBatch]:
        """The local tries of what has been walked since the last call."""
        if self.nodes:
            depth, k1, k2, p1, p2, conv, chars = (np.concatenate(x) for x in zip(*self.nodes, strict=True))
            path = mix64(conv.astype(np.int64).view(np.uint64) * C3).view(np.int64)  # a bijection of the id
            table = pa.table({
                "depth": depth.astype(np.int64), "k1": k1.view(np.int64), "k2": k2.view(np.int64), "p1": p1.view(np.int64), "p2": p2.view(np.int64),
                "conv_id": conv.astype(np.int64), "path": path, "chars": chars.astype(np.int64),
            })
            least = [("p1", "min"), ("p2", "min"), ("conv_id", "min"), ("conv_id", "count"), ("path", "min"), ("chars", "min")]
            made = table.group_by(KEY).aggregate(least)
            names = [*KEY, *(f"{c}_{f}" for c, f in least)]
            for b in made.combine_chunks().to_batches():
                yield self._batch(part, [b.column(c) for c in names], None, None)
        if self.ends:
            lists: dict[tuple, list[int]] = {}
            for depth, k1, k2, conv in self.ends:
                lists.setdefault((depth, k1, k2, conv >> ENDS), []).append(conv)
            keys = np.array([k[1:3] for k in lists], np.uint64).view(np.int64)
            depths = pa.array([k[0] for k in lists], pa.int64())
            yield self._batch(part, [depths, pa.array(keys[:, 0]), pa.array(keys[:, 1])], pa.array([k[3] for k in lists], pa.int64()), pa.array(list(lists.values()), pa.list_(pa.int64())))
        self.nodes, self.ends = [], []

    @staticmethod
    def _batch(part: int, columns: list, bucket, ends) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [*columns, *(pa.nulls(n, pa.int64()) for _ in range(9 - len(columns)))]
        tail = [pa.nulls(n, pa.int64()) if bucket is None else bucket, pa.nulls(n, pa.list_(pa.int64())) if ends is None else ends]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *columns, *tail], [c.split()[0] for c in PARTIAL.split(", ")])


def turn_terms(h1: np.ndarray, h2: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = depth.astype(np.int64).view(np.uint64)
    return mix64(h1.view(np.uint64) + d * C1), mix64(h2.view(np.uint64) + d * C2)


EMPTY = {"block": None, "conv": None, "heads": [], "seen": 0, "wanted": 0, "k": 0, "lanes": (0, 0)}


def carried(turns: DataFrame, shared: Callable[[int], int], most: int) -> tuple[dict[int, dict], dict[int, int]]:
    """What each partition has to know of those before, and the first conversation after it. A row a partition goes to the driver."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = last_block = None
        tail, heads = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, conv = batch.column("block").to_numpy(), batch.column("conv_id").to_numpy()
            first = int(conv[0]) if first is None else first
            if last_block != int(block[-1]):
                last_block, heads = int(block[-1]), []
            some = np.flatnonzero((conv == block) & (block == last_block))[: most - len(heads)]
            heads += [tuple(int(batch.column(c)[i].as_py()) for c in ("h1", "h2", "chars")) for i in some.tolist()]
            n = int((conv[::-1] != conv[-1]).argmax()) or len(conv)
            tail = tail + n if n == len(conv) and int(conv[-1]) == last else n
            last = int(conv[-1])
        if first is not None:
            kept = pa.array([[x for h in heads for x in h]], pa.list_(pa.int64()))
            values = [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), first, last, last_block, tail)]
            yield pa.RecordBatch.from_arrays([*values, kept], ["part", "first", "last", "last_block", "tail", "heads"])

    told = sorted(turns.mapInArrow(tell, "part long, first long, last long, last_block long, tail long, heads array<long>").collect())
    states, after = {}, {}
    state = dict(EMPTY)
    for row in told:
        states[row["part"]] = state
        heads = [tuple(row["heads"][i : i + 3]) for i in range(0, len(row["heads"]), 3)]
        same = state["conv"] == row["last"]
        heads = ((state["heads"] if state["block"] == row["last_block"] else []) + heads)[:most]
        state = EMPTY | {"block": row["last_block"], "conv": row["last"], "heads": heads, "seen": row["tail"] + (state["seen"] if same else 0)}
        if row["last"] == row["last_block"]:
            continue
        state |= {"wanted": shared(row["last"]), "k": min(shared(row["last"]), len(heads))}
    for row, then in zip(told, told[1:], strict=False):
        after[row["part"]] = then["first"]
    split = {row["part"] for row in told if after.get(row["part"]) == row["last"]}
    if split:  # conversations over a border: their sums so far
        lanes: dict[int, tuple[int, int]] = {}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            if part not in split:
                return
            walk = Walk(states[part], shared, most)
            for batch in batches:
                if batch.num_rows:
                    walk.turns(batch)
                    walk.nodes, walk.ends = [], []
            made = np.array(walk.state["lanes"], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, *made.tolist())], ["part", "k1", "k2"])

        for part, k1, k2 in turns.mapInArrow(add, "part long, k1 long, k2 long").collect():
            lanes[part] = (k1 % (1 << 64), k2 % (1 << 64))
        sums: tuple[int, int] = (0, 0)
        for row, then in zip(told, told[1:], strict=False):
            if row["part"] not in split:
                sums = (0, 0)
                continue
            # A partition of one conversation adds to what came before it; any other starts the sum with the shared turns.
            whole = row["first"] == row["last"] and states[row["part"]]["conv"] == row["first"]
            own = lanes[row["part"]]
            sums = tuple((a + b) % (1 << 64) for a, b in zip(sums, own, strict=True)) if whole else own
            states[then["part"]] = states[then["part"]] | {"lanes": sums}
    return states, after


def partial_tries(turns: DataFrame, shared: Callable[[int], int], most: int, local_rows: int) -> DataFrame:
    states, after = carried(turns, shared, most)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        walk = Walk(states.get(part, EMPTY), shared, most)
        for batch in batches:
            if batch.num_rows:
                walk.turns(batch)
                if walk.rows() >= local_rows:
                    yield from walk.taken(part)
        if part in states and after.get(part) != walk.state["conv"]:
            walk.close()
        yield from walk.taken(part)

    return turns.mapInArrow(build, PARTIAL)


def merged(partials: DataFrame, parts: int, fan: int) -> DataFrame:
    """Tree merge: by key and group of ``fan``, until one group is left."""
    least = [F.min(c).alias(c) for c in ("p1", "p2", "conv_id")] + [F.sum("n_convs").alias("n_convs"), F.min("path").alias("path"), F.min("chars").alias("chars")]
    nodes = partials.where("bucket IS NULL").drop("bucket", "ends")
    while parts > fan:
        nodes = nodes.groupBy(*KEY, F.floor(F.col("part") / fan).cast("int").alias("part")).agg(*least)
        parts = math.ceil(parts / fan)
    return nodes.groupBy(*KEY).agg(*least)


def end_digests(partials: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end."""
    import hashlib

    ranges = partials.where("bucket IS NOT NULL").groupBy(*KEY, "bucket").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], [*KEY, "ends_sha256"])

        for batch in batches:
            for *key, ends in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ends")), strict=True):
                text = ",".join(map(str, ends)).encode()
                if key == now:
                    sha.update(b"," + text)
                    continue
                if now:
                    yield out()
                now, sha = key, hashlib.sha256(text)
        if now:
            yield out()

    return ranges.repartition(*KEY).sortWithinPartitions(*KEY, "bucket").select(*KEY, "ends").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def path_totals(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved) over a path and all that hang under it: what a path has moves up a path a round."""
    above = paths.where("up IS NOT NULL").select("path", "up")
    moving = paths.select("path", "leaves", "saved")
    rounds = [moving]
    while True:
        moving = checkpointed(moving.join(above, "path").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        if moving.isEmpty():
            break
        rounds.append(moving)
    return reduce(DataFrame.unionByName, rounds).groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rolled_up(nodes: DataFrame, stretch: int) -> DataFrame:
    """``nodes`` with parent_conv_id, n_children, n_leaves and saved_tokens."""
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    linked = stored(counted.join(parents, ["depth", "p1", "p2"], "left"), "trie-nodes")
    leaf, worth = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    hung = F.max(F.when(F.col("up").isNotNull() & (F.col("up") != F.col("path")), F.struct("up", (F.col("depth") - 1).alias("depth"))))
    paths = checkpointed(linked.groupBy("path").agg(F.sum(leaf).alias("leaves"), F.sum(worth).alias("saved"), hung.alias("hung")).select("path", "leaves", "saved", "hung.up", F.col("hung.depth").alias("hung_at")))
    below = path_totals(paths).join(paths.where("up IS NOT NULL").select("path", "up", "hung_at"), "path")
    below = below.groupBy(F.col("up").alias("path"), F.col("hung_at").alias("depth")).agg(F.sum("leaves").alias("leaves_under"), F.sum("saved").alias("saved_under"))
    own = linked.join(below, ["path", "depth"], "left").withColumns({
        "leaves": leaf + F.coalesce("leaves_under", F.lit(0)), "saved": worth + F.coalesce("saved_under", F.lit(0)), "stretch": F.floor(F.col("depth") / stretch),
    })
    further = Window.partitionBy("path").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = linked.withColumn("stretch", F.floor(F.col("depth") / stretch)).groupBy("path", "stretch").agg(F.sum(leaf).alias("leaves"), F.sum(worth).alias("saved"))
    hung_sums = below.withColumn("stretch", F.floor(F.col("depth") / stretch)).groupBy("path", "stretch").agg(F.sum("leaves_under").alias("leaves"), F.sum("saved_under").alias("saved"))
    sums = sums.unionByName(hung_sums).groupBy("path", "stretch").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = sums.select("path", "stretch", *(F.coalesce(F.sum(c).over(further), F.lit(0)).alias(f"{c}_later") for c in ("leaves", "saved")))
    inside = Window.partitionBy("path", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.join(later, ["path", "stretch"])
    return summed.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", *(
        (F.sum(c).over(inside) + F.col(f"{c}_later")).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))
    ))


def prefix_trie(
    df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", block: int = 1,
    shared: Callable[[int], int] = shared_turns, most: int = 5, rows_a_part: int = ROWS_A_PART, fan: int = FAN, stretch: int = STRETCH, local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``block`` above 1 a conversation c has, in place of its own first
    shared(c) turns (``most`` at the most), those of conversation c - c % block.
    """
    conv, place, who, said = (F.col(c) for c in (key, order, role, text))
    who, said = F.coalesce(who.cast("string"), F.lit("")), F.coalesce(said.cast("string"), F.lit(""))
    conv = conv.cast("long")
    half = lambda digest, at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    digest: Column = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))
    slim = df.where(conv.isNotNull()).select((conv - conv % block).alias("block"), conv.alias("conv_id"), place.alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    slim = stored(slim.select("block", "conv_id", "turn", half("digest", 1).alias("h1"), half("digest", 17).alias("h2"), "chars", F.monotonically_increasing_id().alias("row")), "trie-turns")
    parts = blocks_for(slim.count(), rows_a_part)
    by = [F.col("block"), F.col("conv_id") != F.col("block"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("row")]
    turns = checkpointed(slim.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("block", "conv_id", "h1", "h2", "chars"))
    partials = stored(partial_tries(turns, shared, most, local_rows), "trie-parts")
    nodes = stored(merged(partials, turns.rdd.getNumPartitions(), fan), "trie-merged")
    out = rolled_up(nodes, stretch).join(end_digests(partials), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"), block=100)


ORACLE_OP12 = """
WITH crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda ch: list_transform(range(0, 8), lambda b: (ascii(ch) >> b::INTEGER) & 1)))),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:h] END, o.turns[h + 1:]) AS turns
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
member AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
node AS (
  SELECT turns[1:depth] AS seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM member GROUP BY ALL),
child AS (SELECT seq[1:depth - 1] AS up, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.seq[-1].text) END AS worth
  FROM node n LEFT JOIN child c ON c.up = n.seq AND c.depth = n.depth),
under AS (
  SELECT seq[1:d] AS seq, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(worth) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY ALL)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN under u ON u.depth = n.depth AND u.seq = n.seq LEFT JOIN node p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]
"""
