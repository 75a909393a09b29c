"""The reachability index against naive closures."""

import random

import pytest

from quadspark.operators import reach, terminology
from quadspark.operators.closure import numbered
from quadspark.operators.reach import Reach


def closure(edges):
    up = {}
    for s, o in edges:
        up.setdefault(s, set()).add(o)
    out = {}
    for start in {x for e in edges for x in e}:
        seen, todo = {start}, [start]
        while todo:
            for x in up.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[start] = seen
    return out


@pytest.mark.parametrize("seed, nodes, edges, cycles, most", [(1, 14, 20, False, 0), (2, 16, 20, True, 0), (3, 40, 60, True, 1000)])
def test_index_equals_the_closure(spark, seed, nodes, edges, cycles, most):
    rnd = random.Random(seed)
    drawn = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)]
    rows = [(f"n{a}", f"n{b}") for a, b in (drawn if cycles else [(max(p), min(p)) for p in drawn if p[0] != p[1]])]
    index = Reach.build(spark.createDataFrame(rows + rows[:3] + [(None, "n1")], "s string, o string"), most)
    want = closure(rows)
    pairs = [(a, b) for a in want for b in want]
    got = {tuple(r) for r in index.holds(spark.createDataFrame(pairs + pairs[:9], "s string, o string")).collect()}
    assert got == {(a, b) for a in want for b in want[a]}
    codes, others = sorted(want)[::2], sorted(want)[1::5]
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    implied = {r.s for r in terminology.implied_by(index, of(codes), of(others)).collect()}
    assert implied == {c for c in codes if want[c] & set(others)}
    linear = index.nodes.count() + index.entries.count() + index.onward.count()
    assert linear <= nodes + 3 * edges


def test_unknown_names_and_empty_tables(spark):
    none = spark.createDataFrame([], "s string, o string")
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), (None, "x")], "s string, o string")
    assert [tuple(r) for r in Reach.build(none).holds(pairs).collect()] == [("x", "x")]
    tree = Reach.build(spark.createDataFrame([("a", "b")], "s string, o string"))
    assert {tuple(r) for r in tree.holds(pairs.unionByName(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "z")], "s string, o string"))).collect()} == {("x", "x"), ("a", "b")}


def test_numbered_is_a_dense_order(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS g", "id AS x", "cast(null AS string) AS note")
    got = [(r.pos, r.g, r.x) for r in numbered(rows, "g", "x").orderBy("pos").collect()]
    assert got == [(i + 1, g, x) for i, (g, x) in enumerate(sorted((x % 7, x) for x in range(1000)))]


def test_codes_are_numbered_within_their_terminology(spark):
    rows = [(f"http://t/icd/{i:03d}",) for i in range(50)] + [(f"http://t/atc/{i}",) for i in range(9)] + [("plain",)]
    got = {r.s: r.pos for r in terminology.ordered_by_code(spark.createDataFrame(rows, "s string")).collect()}
    assert got["http://t/icd/049"] == 50 and got["http://t/atc/8"] == 9 and got["plain"] == 1 and len(got) == 60


def test_a_test_of_sets_takes_no_rounds(spark, monkeypatch):
    """A chain of 600 nodes: marks are carried along the walk, not hopped to."""
    rows = [(i, i - 1) for i in range(1, 600)] + [(1000 + i, i) for i in range(0, 600, 7)]
    index = Reach.build(spark.createDataFrame(rows, "s long, o long"))
    written = []
    monkeypatch.setattr("quadspark.operators.reach.checkpointed", lambda df, real=reach.checkpointed: written.append(1) or real(df))
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.s for r in index.implied_by(of([*range(600), *range(1000, 1600, 7)]), of([250, 400, 1007])).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {*range(250, 600), *(1000 + i for i in range(0, 600, 7) if i >= 250), 1007}
    assert len(written) == 2


def test_leaves_are_layers_beside_the_index(spark, monkeypatch):
    """Leaves with two parents each, in two layers over a cycle: no walk of them is numbered by joins, and each is found."""
    top = [("a", "b"), ("b", "a"), ("a", "r"), ("c", "r"), ("c", "c"), ("d", "r2")]
    middle = [(f"m{i}", "abcd"[(i + k) % 4]) for i in range(12) for k in (0, 1)]
    rows = top + middle + [(f"x{i}", f"m{(i * k) % 12}") for i in range(60) for k in (1, 5)] + [("x3", "x3"), ("x4", "e")]
    monkeypatch.setattr(reach, "_tour", None)
    index = Reach.build(spark.createDataFrame(rows, "s string, o string"), 10)
    assert len(index.layers) == 2 and index.nodes.count() <= 8
    want = closure(rows)
    pairs = [(a, b) for a in want for b in want]
    got = {tuple(r) for r in index.holds(spark.createDataFrame(pairs + [("none", "none"), ("x1", "none")], "s string, o string")).collect()}
    assert got == {(a, b) for a in want for b in want[a]} | {("none", "none")}
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    for others in (["a"], ["e", "m7", "x2"], ["d"], ["r2", "none"]):
        implied = {r.s for r in index.implied_by(of([*want, "none"]), of(others)).collect()}
        assert implied == {c for c in want if want[c] & set(others)} | ({"none"} & set(others))


def test_sets_are_compared_by_two_tests_that_broadcast_no_node(spark, monkeypatch):
    rows = [(f"m{i}", f"r{i % 3}") for i in range(12)] + [(f"x{i}", f"m{i * k % 12}") for i in range(60) for k in (1, 5)]
    index = Reach.build(spark.createDataFrame(rows, "s string, o string"), 10)
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    codes, others, want = [f"x{i}" for i in range(0, 60, 2)] + ["r1", "none"], ["r0", "m4", "x2", "x5"], closure(rows) | {"none": {"none"}}
    plan = index.implied_by(of(codes), of(others))._jdf.queryExecution().executedPlan().toString()
    assert index.layers and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    tests = []
    monkeypatch.setattr(terminology, "implied_by", lambda *a, real=terminology.implied_by: tests.append(1) or real(*a))
    got = [tuple(r) for r in terminology.compared(index, of(codes), of(others)).collect()]
    implied, back = {c for c in codes if want[c] & set(others)}, {c for c in others if want[c] & set(codes)}
    each = {"implied": implied, "subtract": set(codes) - implied, "common": implied | back}
    assert len(tests) == 2 and sorted(got) == sorted((op, s) for op, found in each.items() for s in found)


def test_what_is_asked_is_worked_out_once(spark):
    """The frame of pairs may be a join of whole tables: a test of it reads it once."""
    index = Reach.build(spark.createDataFrame([("b", "a"), ("c", "b")], "s string, o string"))
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        seen.add(1)
        return rows

    rows = spark.createDataFrame([("c", "a"), ("a", "c"), ("z", "z")], "s string, o string").coalesce(1)
    pairs = rows.mapInPandas(lambda frames: map(counted, frames), "s string, o string")
    assert {tuple(r) for r in index.holds(pairs).collect()} == {("c", "a"), ("z", "z")}
    assert seen.value == 1
