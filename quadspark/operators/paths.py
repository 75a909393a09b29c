"""Property paths: ``/ | ^ ? * + !`` as reachability over (node, state).

A path is built of properties: ``Prop(p)``, ``~x`` backwards, ``x / y`` one after
the other, ``x | y`` either, ``x.star()``, ``x.plus()``, ``x.maybe()`` and
``But(p, q)``, any property but these. It becomes an automaton with a state for
each property in it (positions and which may follow which), so that a round is
one join of the frontier with the edges of each state; a frontier holds only what
the round before has found. Of several rounds only the first and last meet names. A constant start or end seeds the walk: from an end
the path is walked backwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import QuadStore
from .closure import checkpointed, code, coded, stored, with_names


@dataclass(frozen=True)
class Path:
    def __truediv__(self, other: Path) -> Path:
        return Seq(self, other)

    def __or__(self, other: Path) -> Path:
        return Either(self, other)

    def plus(self) -> Path:
        return Many(self)

    def maybe(self) -> Path:
        return Maybe(self)

    def star(self) -> Path:
        return Maybe(Many(self))


@dataclass(frozen=True)
class Prop(Path):
    p: str
    back: bool = False

    def __invert__(self) -> Prop:
        return Prop(self.p, not self.back)

    def edges(self, store: QuadStore) -> DataFrame:
        rows = store.scan("objs", p=self.p).select("s", "o")
        return rows.select(F.col("o").alias("s"), F.col("s").alias("o")) if self.back else rows


@dataclass(frozen=True)
class But(Path):
    names: tuple[str, ...]
    back: bool = False

    def __init__(self, *names: str, back: bool = False):
        object.__setattr__(self, "names", names)
        object.__setattr__(self, "back", back)

    def __invert__(self) -> But:
        return But(*self.names, back=not self.back)

    def edges(self, store: QuadStore) -> DataFrame:
        rows = store.objs.where(~F.col("p").isin(*self.names)).select("s", "o")
        return rows.select(F.col("o").alias("s"), F.col("s").alias("o")) if self.back else rows


@dataclass(frozen=True)
class Seq(Path):
    a: Path
    b: Path

    def __invert__(self) -> Path:
        return Seq(~self.b, ~self.a)


@dataclass(frozen=True)
class Either(Path):
    a: Path
    b: Path

    def __invert__(self) -> Path:
        return Either(~self.a, ~self.b)


@dataclass(frozen=True)
class Many(Path):
    a: Path

    def __invert__(self) -> Path:
        return Many(~self.a)


@dataclass(frozen=True)
class Maybe(Path):
    a: Path

    def __invert__(self) -> Path:
        return Maybe(~self.a)


@dataclass
class Automaton:
    """``steps``: the property of each state; ``before``: the states (0 is the start) that each may follow; ``ends``: states that accept."""

    steps: dict[int, Prop | But] = field(default_factory=dict)
    before: dict[int, set[int]] = field(default_factory=dict)
    ends: set[int] = field(default_factory=set)
    empty: bool = False

    @classmethod
    def of(cls, path: Path) -> Automaton:
        made = cls()
        first, made.ends, made.empty = made._add(path)
        for state in first:
            made.before[state].add(0)
        return made

    def _add(self, path: Path) -> tuple[set[int], set[int], bool]:
        """(first states, last states, may be empty)"""
        if isinstance(path, (Prop, But)):
            state = len(self.steps) + 1
            self.steps[state], self.before[state] = path, set()
            return {state}, {state}, False
        first, last, empty = self._add(path.a)
        if isinstance(path, Maybe):
            return first, last, True
        if isinstance(path, Many):
            for state in first:
                self.before[state] |= last
            return first, last, empty
        first2, last2, empty2 = self._add(path.b)
        if isinstance(path, Either):
            return first | first2, last | last2, empty or empty2
        for state in first2:
            self.before[state] |= last
        return first | (first2 if empty else set()), last2 | (last if empty2 else set()), empty and empty2

    def after(self, at: set[int]) -> set[int]:
        """The states that may follow one of ``at``."""
        return {state for state, before in self.before.items() if before & at}

    def again(self) -> set[int]:
        """The states that a walk may come to in different rounds; rows of any other state are all found in one round."""
        seen: set[int] = set()
        out: set[int] = set()
        at = {0}
        for _ in range(2 * len(self.steps)):
            at = self.after(at)
            out |= at & seen
            seen |= at
        return out


def follow(store: QuadStore, path: Path, start: str | DataFrame | None = None, end: str | None = None) -> DataFrame:
    """Distinct (s, o) such that the path leads from s to o.

    ``start``: one node, or a frame whose first column has the nodes; ``end``: one
    node. Without either every node of a triple is a start, and the path is walked
    from that side which has fewer nodes, as a walk holds at most a row for each
    of these with each node and state. A path that may be empty leads from each
    start to itself.
    """
    flipped = lambda rows: rows.select(F.col("o").alias("s"), F.col("s").alias("o"))
    if start is None and end is not None:
        return flipped(follow(store, ~path, end))
    spark, made = store.objs.sparkSession, Automaton.of(path)
    kinds = list(dict.fromkeys(made.steps.values()))
    edges = reduce(DataFrame.unionByName, [k.edges(store).select(F.lit(i).alias("kind"), "s", "o") for i, k in enumerate(kinds)])
    if start is None and not made.empty:
        first, last = (F.col("kind").isin(*sorted({kinds.index(made.steps[i]) for i in at})) for at in ([i for i, b in made.before.items() if 0 in b], made.ends))
        sizes = edges.where(first | last).agg(*(F.approx_count_distinct(F.when(at, F.col(c))) for at, c in ((first, "s"), (last, "o")))).first()
        if sizes[1] < sizes[0]:
            return flipped(follow(store, ~path, edges.where(last).select("o")))
        start = edges.where(first).select("s")
    again = made.again()
    if isinstance(start, str):
        seeds = spark.createDataFrame([(start,)], "s string")
    elif start is not None:
        seeds = start.select(F.col(start.columns[0]).alias("s")).distinct()
    else:
        seeds = store.quads.select("s").unionByName(store.objs.select(F.col("o").alias("s"))).distinct()
    if again:  # names are met once and rounds move their numbers
        edges, seeds = stored(edges.distinct(), "path-edges"), stored(seeds, "path-seeds")
        names, seed = coded(reduce(DataFrame.unionByName, [edges.select(F.col(c).alias("name")) for c in ("s", "o")] + [seeds.select(F.col("s").alias("name"))]))
        starts = stored(names.join(seeds.select(F.col("s").alias("name")), "name", "left_semi").select("id", "name"), "path-seeds")
        edges, seeds = stored(edges.select("kind", code("s", seed).alias("s"), code("o", seed).alias("o")), "path-edges"), starts.select(F.col("id").alias("s"))
    frontier = checkpointed(seeds.select("s", F.col("s").alias("o"), F.lit(0).alias("state")))
    found, at = [frontier], {0}
    while at := made.after(at):
        steps = []
        for state in sorted(at):
            ready = frontier.where(F.col("state").isin(*made.before[state])).select(F.col("s").alias("from"), F.col("o").alias("s"))
            steps.append(ready.join(edges.where(F.col("kind") == kinds.index(made.steps[state])), "s").select(F.col("from").alias("s"), "o", F.lit(state).alias("state")))
        new = reduce(DataFrame.unionByName, steps)
        if not made.after(at):  # nothing goes on from here
            found.append(new)
            break
        new = new.distinct()
        if at & again:
            known = reduce(DataFrame.unionByName, found).where(F.col("state").isin(*again))
            new = new.join(known, ["s", "o", "state"], "left_anti")
        frontier = checkpointed(new)
        if frontier.isEmpty():
            break
        found.append(frontier)
    good = [*made.ends, *([0] if made.empty else [])]
    out = reduce(DataFrame.unionByName, found).where(F.col("state").isin(*good)).select("s", "o").distinct()
    out = with_names(out, starts, names) if again else out
    return out if end is None else out.where(F.col("o") == end)
