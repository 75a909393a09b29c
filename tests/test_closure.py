from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadspark.functions import vocab as v
from quadspark.operators import closure
from quadspark.operators.closure import Hierarchy, closure_pairs, components, list_items, reachable, roots

EDGES = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12)
SOME = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def naive(edges):
    pairs = set(edges)
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in edges if b == c}
        if more == pairs:
            return pairs
        pairs = more


@SOME
@given(EDGES)
def test_closures(spark, edges):
    frame = spark.createDataFrame(edges, "s int, o int")
    want = naive(edges)
    assert {tuple(r) for r in closure_pairs(frame).collect()} == want
    seed = spark.createDataFrame([(3,)], "s int")
    assert {r.s for r in reachable(frame, seed).collect()} == {a for a, b in want if b == 3}


@SOME
@given(EDGES)
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "s int, o int")).collect()}
    linked = naive(edges + [(b, a) for a, b in edges])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: min({n} | {b for a, b in linked if a == n}) for n in nodes}


def test_a_fingerprint_of_many_rows_does_not_overflow(spark):
    """A sum of hashes below 2^40 as a whole number did, at some 17 million rows; components compare their rounds by it."""
    rows = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert closure.fingerprint(rows)[0] == 20_000_000
    assert closure.fingerprint(rows.where("a < 9")) == closure.fingerprint(rows.where("a < 9").repartition(3)) != closure.fingerprint(rows.where("a < 8"))


def test_hierarchy(spark):
    h = Hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "s string, o string"))
    assert {r[0] for r in h.below(spark, ["c"]).collect()} == {"a", "b", "c", "d"}
    assert {r[0] for r in h.above(spark, ["d"]).collect()} == {"a", "b", "c", "d"}
    assert [r[0] for r in roots(spark.createDataFrame([("b", "a"), ("c", "b")], "s string, o string")).collect()] == ["a"]


def test_lists_written_as_one_are_linked_where_they_lie(spark, monkeypatch):
    """No cell takes part in a join by name; cells that are dealt apart are still joined."""
    pair = lambda rows: spark.createDataFrame(rows, "s string, o string")
    lists = [[f"l{n}.{i}" for i in range(n)] for n in range(1, 40)]
    rest = [(a, b) for cells in lists for a, b in zip(cells, [*cells[1:], v.NIL], strict=True)]
    want = {(x[0], i + 1, c, len(x)) for x in lists for i, c in enumerate(x)}
    run = lambda frame: {tuple(r) for r in list_items(None, frame).collect()}
    assert run(pair(rest).repartition(13)) == want
    real = closure.checkpointed
    written = []
    monkeypatch.setattr(closure, "checkpointed", lambda f: written.append((f := real(f)).count()) or f)
    assert run(pair(rest).coalesce(1)) == want
    assert sum(written) == len(rest)


def test_list_items(spark):
    lists = {f"l{n}": [f"l{n}.{i}" for i in range(n)] for n in (1, 2, 3, 4, 7, 8, 9)}
    rest = [(a, b) for cells in lists.values() for a, b in zip(cells, [*cells[1:], v.NIL], strict=True)]
    broken = [("b0", "b1"), ("b1", "gone")]
    cyclic = [("c0", "c1"), ("c1", "c2"), ("c2", "c1"), ("d0", "d0")]
    cells = [a for a, _ in rest + broken + cyclic]
    heads = [(k, x[0]) for k, x in lists.items()] + [("b", "b0"), ("c", "c0"), ("d", "d0")]
    pair = lambda rows: spark.createDataFrame(rows, "s string, o string")
    run = lambda r: {(x.lst, x.pos, x.item) for x in list_items(pair([(c, f"of {c}") for c in cells]), r, spark.createDataFrame(heads, "lst string, node string")).collect()}
    want = {(k, i + 1, f"of {c}") for k, x in lists.items() for i, c in enumerate(x)}
    assert run(pair(rest + broken + cyclic)) == want | {("b", 1, "of b0"), ("b", 2, "of b1")}
    assert run(pair([])) == set()


def test_cyclic_parts_by_brute_force(spark):
    import random

    rng = random.Random(7)
    for n, m in ((8, 10), (12, 16), (20, 24), (6, 0)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in edges}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
            if more == reach:
                break
            reach = more
        want = {(a, min(b for b in range(n) if (a, b) in reach and (b, a) in reach)) for a in range(n) if (a, a) in reach}
        frame = spark.createDataFrame(sorted(edges), "s bigint, o bigint")
        assert {tuple(r) for r in closure.cyclic_parts(frame).collect()} == want
        assert {tuple(r) for r in closure.cyclic_parts(frame, most=0).collect()} == want
        assert {tuple(r) for r in closure.closure_pairs(frame).collect()} == reach


def _parts(edges):
    """(node, least node of its part) of nodes on cycles, by all pairs."""
    reach = set(edges)
    while (more := reach | {(a, d) for a, b in reach for c, d in edges if b == c}) != reach:
        reach = more
    return {(a, min(b for b in {y for x, y in reach if x == a} if (b, a) in reach)) for a, b in reach if a == b}


def test_cyclic_parts_by_contraction_against_brute_force(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(34)} | {(100 + i, 101 + i) for i in range(20)}
        edges |= {(200 + i, 200 + (i + 1) % 9) for i in range(9)} | {(60 - i, 59 - i) for i in range(9)} | {(51, 1), (3, 60), (120, 300), (300, 100), (300, 300), (7, 401), (401, 402), (402, 7)}
        got = closure.cyclic_parts(spark.createDataFrame(sorted(edges), "s long, o long"), most=0)
        assert sorted(map(tuple, got.collect())) == sorted(_parts(edges))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = closure.checkpointed
    monkeypatch.setattr(closure, "checkpointed", lambda df: rounds.append(1) or real(df))
    chain = spark.range(2_000).selectExpr("id AS s", "id + 1 AS o")
    assert closure.cyclic_parts(chain, most=0).count() == 0
    assert len(rounds) <= 30  # a round for each doubling


def test_the_estimated_size_of_a_loop_is_that_of_its_rows(spark):
    rows = spark.range(20).toDF("a")
    for _ in range(6):  # each estimate would be the product of two before it: 2**6 times the digits
        rows = closure.checkpointed(rows.join(rows.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a"))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
    assert rows.count() == 20


def test_lists_are_ordered_by_numbers(spark, monkeypatch):
    """Names of cells are met as they are numbered; what the rounds write is numbers alone."""
    cells = [f"c{i}" for i in range(20)]
    pair = lambda rows: spark.createDataFrame(rows, "s string, o string")
    written = []
    monkeypatch.setattr(closure, "checkpointed", lambda df, real=closure.checkpointed: written.append({t for _, t in df.dtypes}) or real(df))
    got = {tuple(x) for x in list_items(pair([(c, c.upper()) for c in cells]), pair(list(zip(cells, [*cells[1:], v.NIL], strict=True)) + [("x", "gone")])).collect()}
    assert got == {("c0", i + 1, c.upper(), 20) for i, c in enumerate(cells)}
    assert len(written) > 5 and all(t <= {"bigint", "boolean"} for t in written[1:])
