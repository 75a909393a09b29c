"""Property paths against relations as sets of pairs."""

import random

from quadspark.operators import closure, paths
from quadspark.operators.closure import checkpointed
from quadspark.operators.paths import Automaton, But, Either, Many, Maybe, Prop, Seq, follow
from quadspark.sources.store import QuadStore


def relation(path, rows, nodes):
    if isinstance(path, (Prop, But)):
        keep = (lambda p: p == path.p) if isinstance(path, Prop) else (lambda p: p not in path.names)
        return {(o, s) if path.back else (s, o) for s, p, o in rows if keep(p)}
    a = relation(path.a, rows, nodes)
    if isinstance(path, Maybe):
        return a | {(x, x) for x in nodes}
    if isinstance(path, Many):
        while (more := a | {(x, z) for x, y in a for y2, z in a if y == y2}) != a:
            a = more
        return a
    b = relation(path.b, rows, nodes)
    return a | b if isinstance(path, Either) else {(x, z) for x, y in a for y2, z in b if y == y2}


def test_paths_against_sets(spark):
    rng = random.Random(5)
    rows = {(f"n{rng.randrange(8)}", rng.choice("pqr"), f"n{rng.randrange(8)}") for _ in range(14)} | {("n8", "p", "n9")}
    nodes = {x for s, _, o in rows for x in (s, o)}
    store = QuadStore.of_rows(spark, [("g", *r) for r in rows])
    p, q, r = (Prop(x) for x in "pqr")
    for path in (p / q.star(), (p | ~q).plus() / r.maybe(), ~(p / ~q), But("p"), (~But("p", "q") | p).star(), ((p / q).plus() | r).maybe()):
        want = relation(path, rows, nodes)
        assert {tuple(x) for x in follow(store, path).collect()} == want
        assert {tuple(x) for x in follow(store, path, start="n1").collect()} == {x for x in want if x[0] == "n1"}
        assert {tuple(x) for x in follow(store, path, end="n2").collect()} == {x for x in want if x[1] == "n2"}
    some = spark.createDataFrame([("n1",), ("n3",), ("n1",)], "x string")
    assert {tuple(x) for x in follow(store, p.plus(), start=some, end="n9").collect()} == {x for x in relation(p.plus(), rows, nodes) if x[0] in ("n1", "n3") and x[1] == "n9"}


def test_automaton_of_nested_repeats():
    made = Automaton.of(((Prop("a") / Prop("b").maybe()).plus() | Prop("c")).star())
    assert made.empty and made.ends == {1, 2, 3}
    assert made.before == {1: {0, 1, 2, 3}, 2: {1}, 3: {0, 1, 2, 3}}


def test_walks_begin_at_the_side_with_fewer_nodes(spark, monkeypatch):
    """40 nodes beneath one another and two ends: a row is held for each end, not for each node above; states of one round are compared with no other."""
    rows = [("g", f"n{i}", "up", f"n{i // 2}") for i in range(1, 40)] + [("g", f"n{i}", "in", f"e{i % 2}") for i in range(40)]
    held = []
    monkeypatch.setattr("quadspark.operators.paths.checkpointed", lambda df, real=checkpointed: held.append(real(df)) or held[-1])
    path = Prop("up").star() / Prop("in")
    got = {tuple(x) for x in follow(QuadStore.of_rows(spark, rows), path).collect()}
    assert got == relation(path, {r[1:] for r in rows}, {f"n{i}" for i in range(40)})
    assert sum(h.count() for h in held) <= 2 + 40 + 2 * 40
    assert Automaton.of(path).again() == {1, 2} and Automaton.of(~path).again() == {2} and not Automaton.of((Prop("a") | Prop("b")) / Prop("c")).again()


def test_rounds_of_a_walk_move_numbers(spark, monkeypatch):
    """Also where two names share a number under the first seed."""
    real = closure.code
    for module in (closure, paths):
        monkeypatch.setattr(module, "code", lambda name, seed: real(name, seed) % 2 if seed == 0 else real(name, seed))
    held = []
    monkeypatch.setattr(paths, "checkpointed", lambda df: held.append(checkpointed(df)) or held[-1])
    rows = [("g", f"n{i}", "up", f"n{i // 2}") for i in range(1, 12)]
    got = {tuple(x) for x in follow(QuadStore.of_rows(spark, rows), Prop("up").plus()).collect()}
    assert got == relation(Prop("up").plus(), {r[1:] for r in rows}, {f"n{i}" for i in range(12)})
    assert held and {dict(h.dtypes)[c] for h in held for c in ("s", "o")} == {"bigint"}
