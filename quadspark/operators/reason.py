"""Forward-chaining inference over a store: a subset of OWL 2 RL as joins, and clashes.

Axioms are metadata: they are read once and become a plan. Facts stay in Spark;
a round joins all facts at once, and rounds go on until nothing is new.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.store import QuadStore
from .closure import checkpointed, closure_pairs, metadata
from .constructs import Evaluator, Reader, lists, restrictions
from .schema import disjoints
from .values import _ancestors, most_specific, same_classes

INFERRED = "http://inferred/"


def _swap(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))


def domain_range_types(store: QuadStore) -> DataFrame:
    """(s, cls) from the domains and ranges of properties in use."""
    axioms = lambda p: metadata(store.scan("objs", p=p).select(F.col("s").alias("p"), F.col("o").alias("cls")).where("NOT startswith(cls, '_:')"))
    facts = store.objs.select("s", "p", "o")
    subjects = facts.select("s", "p").unionByName(store.datas.select("s", "p"))
    return subjects.join(axioms(v.DOMAIN), "p").select("s", "cls").unionByName(facts.join(axioms(v.RANGE), "p").select(F.col("o").alias("s"), "cls")).distinct()


_AXIOMS = (v.SUBCLASS, v.EQUIVALENT_CLASS, v.SUBPROPERTY, v.EQUIVALENT_PROPERTY, v.DOMAIN, v.RANGE, v.INVERSE_OF, v.ON_PROPERTY)
_KINDS = (v.SYMMETRIC, v.TRANSITIVE, v.FUNCTIONAL, v.INVERSE_FUNCTIONAL)


def _present(store: QuadStore) -> set[str]:
    """Which kinds of axioms there are: rules without axioms take no part in the plan."""
    links = store.scan("objs", p=list(_AXIOMS)).select("p").distinct()
    return {r[0] for r in links.unionByName(store.scan("objs", p=v.TYPE, o=list(_KINDS)).select(F.col("o").alias("p")).distinct()).collect()}


def _round(store: QuadStore) -> DataFrame | None:
    """(s, p, o) that one application of the rules gives; None where no rule has an axiom."""
    has = _present(store)
    facts = store.objs.select("s", "p", "o")
    types = store.scan("objs", p=v.TYPE).select("s", "p", "o")
    axiom = lambda p: store.scan("objs", p=p).select("s", "o")
    kinds = lambda k: metadata(store.scan("objs", p=v.TYPE, o=k).select(F.col("s").alias("p")))
    same = lambda a: a.where("x <> y").select(F.col("x").alias("s"), F.lit(v.SAME_AS).alias("p"), F.col("y").alias("o"))
    out: list[DataFrame] = []
    if has & {v.SUBCLASS, v.EQUIVALENT_CLASS}:
        below = metadata(_ancestors(store).withColumnRenamed("s", "low").withColumnRenamed("o", "high"))
        out.append(types.join(below, F.col("o") == F.col("low")).select("s", "p", F.col("high").alias("o")))
        out.append(below.select(F.col("low").alias("s"), F.lit(v.SUBCLASS).alias("p"), F.col("high").alias("o")))
    if has & {v.SUBPROPERTY, v.EQUIVALENT_PROPERTY}:
        sub = axiom(v.SUBPROPERTY).unionByName(axiom(v.EQUIVALENT_PROPERTY)).unionByName(_swap(axiom(v.EQUIVALENT_PROPERTY)))
        out.append(facts.join(metadata(sub.select(F.col("s").alias("p"), F.col("o").alias("q"))), "p").select("s", F.col("q").alias("p"), "o"))
    if has & {v.DOMAIN, v.RANGE}:
        out.append(domain_range_types(store).select("s", F.lit(v.TYPE).alias("p"), F.col("cls").alias("o")))
    if v.INVERSE_OF in has:
        inverse = axiom(v.INVERSE_OF).where("NOT startswith(s, '_:') AND NOT startswith(o, '_:')")
        both = metadata(inverse.unionByName(_swap(inverse)).select(F.col("s").alias("p"), F.col("o").alias("q")))
        out.append(facts.join(both, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
    if v.SYMMETRIC in has:
        out.append(facts.join(kinds(v.SYMMETRIC), "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
    if v.TRANSITIVE in has:
        moving = facts.join(kinds(v.TRANSITIVE), "p", "left_semi")
        out.append(moving.alias("a").join(moving.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.s"))).select("a.s", "a.p", "b.o"))
    if v.FUNCTIONAL in has:
        one = facts.join(kinds(v.FUNCTIONAL), "p", "left_semi")
        out.append(same(one.alias("a").join(one.groupBy("s", "p").agg(F.min("o").alias("y")).alias("b"), ["s", "p"]).select(F.col("o").alias("x"), "y")))
    if v.INVERSE_FUNCTIONAL in has:
        one = facts.join(kinds(v.INVERSE_FUNCTIONAL), "p", "left_semi")
        out.append(same(one.join(one.groupBy("o", "p").agg(F.min("s").alias("y")), ["o", "p"]).select(F.col("s").alias("x"), "y")))
    if v.ON_PROPERTY in has:
        out += _restriction_rules(store, facts, types, same)
    return reduce(lambda a, b: a.unionByName(b), out).distinct() if out else None


def _restriction_rules(store: QuadStore, facts: DataFrame, types: DataFrame, same: Callable) -> list[DataFrame]:
    """What restrictions give: types of those that meet them, values and types of values for members."""
    out = []
    view = checkpointed(restrictions(store).where("NOT inverse"))
    some = metadata(view.where("kind = 'some' AND filler IS NOT NULL AND source = 'equivalent_to'"))
    has = facts.join(some, facts["p"] == some["property"])
    out.append(
        has.join(types.select(F.col("s").alias("o"), F.col("o").alias("filler")), ["o", "filler"], "left_semi").unionByName(has.where(F.col("filler") == v.THING).select("o", "filler", *[c for c in has.columns if c not in ("o", "filler")]))
        .select("s", F.lit(v.TYPE).alias("p"), F.col("cls").alias("o"))
    )
    # At most one value: all the values of an individual are the same.
    one = metadata(view.where("kind = 'max' AND cardinality = 1 AND filler IS NULL").select(F.col("cls").alias("o"), F.col("property").alias("q")))
    held = types.join(one, "o").select("s", F.col("q").alias("p")).distinct().join(facts, ["s", "p"])
    out.append(same(held.join(held.groupBy("s", "p").agg(F.min("o").alias("y")), ["s", "p"]).select(F.col("o").alias("x"), "y")))
    value = metadata(view.where("kind = 'value' AND filler IS NOT NULL"))
    out.append(types.join(value, types["o"] == value["cls"]).select("s", F.col("property").alias("p"), F.col("filler").alias("o")))
    out.append(facts.join(value.where("source = 'equivalent_to'"), (facts["p"] == F.col("property")) & (facts["o"] == F.col("filler"))).select("s", F.lit(v.TYPE).alias("p"), F.col("cls").alias("o")))
    only = metadata(view.where("kind = 'only' AND filler IS NOT NULL"))
    inside = types.join(only, types["o"] == only["cls"]).select(F.col("s").alias("x"), F.col("property").alias("q"), "filler")
    out.append(facts.join(inside, (facts["s"] == F.col("x")) & (facts["p"] == F.col("q"))).select(F.col("o").alias("s"), F.lit(v.TYPE).alias("p"), F.col("filler").alias("o")).where("NOT startswith(o, '_:')"))
    return out


def _lists_rules(store: QuadStore) -> DataFrame | None:
    """(s, p, o) from intersections, unions, enumerations and chains; None where the store has no list."""
    if not store.has("objs", p=v.REST):
        return None
    members = checkpointed(lists(store))
    facts = store.objs.select("s", "p", "o")
    types = facts.where(F.col("p") == v.TYPE).select("s", "o")
    same = store.scan("objs", p=v.EQUIVALENT_CLASS).select(F.col("s").alias("cls"), F.col("o").alias("node"))
    named = lambda p: same.join(store.scan("objs", p=p).select(F.col("s").alias("node"), F.col("o").alias("lst")), "node").join(members, "lst").select("cls", "item")
    inter, union, one = metadata(named(v.INTERSECTION)), metadata(named(v.UNION)), named(v.ONE_OF)
    size = inter.groupBy("cls").agg(F.count("*").alias("n"))
    full = types.join(inter, types["o"] == inter["item"]).groupBy("s", "cls").agg(F.count_distinct("item").alias("k")).join(size, "cls").where("k = n")
    parts = [
        full.select("s", F.lit(v.TYPE).alias("p"), F.col("cls").alias("o")),
        types.join(inter, types["o"] == inter["cls"]).where("NOT startswith(item, '_:')").select("s", F.lit(v.TYPE).alias("p"), F.col("item").alias("o")),
        types.join(union, types["o"] == union["item"]).select("s", F.lit(v.TYPE).alias("p"), F.col("cls").alias("o")),
        one.select(F.col("item").alias("s"), F.lit(v.TYPE).alias("p"), F.col("cls").alias("o")),
    ]
    chains = store.scan("objs", p=v.CHAIN).select(F.col("s").alias("q"), F.col("o").alias("lst")).join(members, "lst").orderBy("q", "lst", "pos").collect()
    steps: dict[tuple, list[str]] = {}
    for r in chains:  # axioms, not facts
        steps.setdefault((r["q"], r["lst"]), []).append(r["item"])
    for (q, _), props in steps.items():
        pairs = reduce(lambda a, b: a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o").distinct(), [store.pairs(p) for p in props])
        parts.append(pairs.select("s", F.lit(q).alias("p"), "o"))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def infer(store: QuadStore, graph: str = INFERRED, most_rounds: int = 50) -> QuadStore:
    """The store with inferred types, relations, subsumptions and sameAs, in graph ``graph``.

    Of individuals that are the same, the least in name has the facts of all, on
    either end, and the others a sameAs to it and from it: a row for the class,
    not one for every pair of names. ``for_members`` spells out the others'.
    """
    for _ in range(most_rounds):
        each = [x for x in (_round(store), _lists_rules(store)) if x is not None]
        if not each and not store.has("objs", p=v.SAME_AS):
            return store
        new = reduce(lambda a, b: a.unionByName(b), each) if each else store.objs.limit(0).select("s", "p", "o")
        if store.has("objs", p=v.SAME_AS):
            same = checkpointed(same_classes(store))
            star = same.where("node <> component").select(F.col("node").alias("s"), F.lit(v.SAME_AS).alias("p"), F.col("component").alias("o"))
            facts = store.objs.where(~F.col("p").isin(v.SAME_AS, v.FIRST, v.REST)).select("s", "p", "o").unionByName(new)
            named = facts.join(same.withColumnRenamed("node", "s").withColumnRenamed("component", "sc"), "s", "left").join(same.withColumnRenamed("node", "o").withColumnRenamed("component", "oc"), "o", "left")
            least = named.select(F.coalesce("sc", "s").alias("s"), "p", F.when(F.col("p") == v.TYPE, F.col("o")).otherwise(F.coalesce("oc", "o")).alias("o"))
            new = least.unionByName(star).unionByName(_swap(star).select("s", F.lit(v.SAME_AS).alias("p"), "o"))
        fresh = checkpointed(new.distinct().join(store.objs, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            return store
        store = store.plus("objs", fresh.select(F.lit(graph).alias("c"), "s", "p", "o"))
    raise RuntimeError("inference did not come to an end")


def for_members(store: QuadStore, p: str | None = None) -> DataFrame:
    """(s, p, o) of an inferred store with the facts of each sameAs class spelled out for all its names as subjects."""
    facts = store.scan("objs", p=p).where(F.col("p") != v.SAME_AS).select("s", "p", "o")
    same = same_classes(store)
    more = facts.join(same.select(F.col("component").alias("s"), "node"), "s").select(F.col("node").alias("s"), "p", "o")
    return facts.unionByName(more).distinct()


def new_relations(derived: DataFrame, asserted: DataFrame, both_ways: bool = True) -> DataFrame:
    """(s, o) derived but not asserted, in either direction if asked."""
    known = asserted.select("s", "o")
    known = known.unionByName(_swap(known)) if both_ways else known
    return derived.join(known, ["s", "o"], "left_anti").distinct()


def violations(store: QuadStore) -> DataFrame:
    """(s, kind): disjoint types or properties, asymmetric or irreflexive relations, members of Nothing, same and different, too many values.

    Disjointness is stated in pairs or for a list: a subject that has two members
    of one group clashes, so a group is one row for each member, not for each pair.
    """
    clashing = [v.DISJOINT_WITH, v.PROPERTY_DISJOINT, v.DIFFERENT_FROM, v.MEMBERS, v.DISTINCT_MEMBERS, v.ON_PROPERTY]
    kinds = store.scan("objs", p=v.TYPE, o=[v.IRREFLEXIVE, v.ASYMMETRIC, v.NOTHING]).select(F.col("o").alias("p"))
    has = {r[0] for r in store.scan("objs", p=clashing).select("p").unionByName(kinds).distinct().collect()}
    types, facts = store.scan("objs", p=v.TYPE).select("s", "o").distinct(), store.objs.select("s", "p", "o")
    of_kind = lambda k: metadata(store.scan("objs", p=v.TYPE, o=k).select(F.col("s").alias("p")))
    found = [types.limit(0).select("s", F.lit("").alias("kind"))]
    add = lambda rows, kind: found.append(rows.select("s", F.lit(kind).alias("kind")))
    if has & {v.DISJOINT_WITH, v.MEMBERS}:
        groups = metadata(disjoints(store).withColumnRenamed("member", "o"))
        add(types.join(groups, "o").groupBy("s", "grp").agg(F.count_distinct("o").alias("n")).where("n > 1"), "disjoint")
    if has & {v.PROPERTY_DISJOINT, v.MEMBERS}:
        apart = metadata(disjoints(store, "properties").withColumnRenamed("member", "p"))
        add(facts.join(apart, "p").groupBy("s", "o", "grp").agg(F.count_distinct("p").alias("n")).where("n > 1"), "disjoint properties")
    if has & {v.DIFFERENT_FROM, v.DISTINCT_MEMBERS, v.MEMBERS}:
        differ = disjoints(store, "individuals").withColumnRenamed("member", "node")
        add(same_classes(store).join(differ, "node").groupBy("component", "grp").agg(F.min("node").alias("s"), F.count_distinct("node").alias("n")).where("n > 1"), "same and different")
    if v.ON_PROPERTY in has:
        none = metadata(restrictions(store).where("NOT inverse AND kind IN ('max', 'exactly') AND cardinality = 0 AND filler IS NULL").select(F.col("cls").alias("o"), F.col("property").alias("p")))
        add(types.join(none, "o").select("s", "p").join(facts.select("s", "p"), ["s", "p"], "left_semi"), "too many values")
    if v.IRREFLEXIVE in has:
        add(facts.join(of_kind(v.IRREFLEXIVE), "p", "left_semi").where("s = o"), "irreflexive")
    if v.ASYMMETRIC in has:
        one = facts.join(of_kind(v.ASYMMETRIC), "p", "left_semi")
        add(one.join(one.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"], "left_semi"), "asymmetric")
    if v.NOTHING in has:
        add(types.where(F.col("o") == v.NOTHING), "nothing")
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def realised_types(store: QuadStore) -> DataFrame:
    """(s, cls): each individual's most specific named classes."""
    types = store.scan("objs", p=v.TYPE).select("s", F.col("o").alias("cls")).where("NOT startswith(cls, '_:')").distinct()
    return most_specific(types, _ancestors(store))



def fusion_types(store: QuadStore) -> DataFrame:
    """(s, classes, fusion): individuals with several most specific classes, and the name of the class that joins them."""
    each = realised_types(store).where(~F.col("cls").isin(v.INDIVIDUAL, v.THING)).groupBy("s").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    return each.where(F.size("classes") > 1).withColumn("fusion", F.array_join(F.transform("classes", lambda c: F.regexp_extract(c, "([^/#]+)$", 1)), "_"))


def inferred_equivalents(store: QuadStore) -> DataFrame:
    """(s, o): named classes that are each beneath the other, with the least of them."""
    links = _ancestors(store).where("s <> o AND NOT startswith(s, '_:') AND NOT startswith(o, '_:')")
    both = links.join(_swap(links), ["s", "o"], "left_semi")
    return both.groupBy("s").agg(F.least(F.min("o"), F.col("s")).alias("o")).where("s <> o")


def realise_defined(store: QuadStore, graph: str = INFERRED, most_rounds: int = 20) -> QuadStore:
    """The store with the members of defined classes, after closing: whoever meets a definition belongs to its class.

    Definitions are evaluated on what the store states, absence counting as
    falsehood, again and again until no individual is new: a definition may use
    another one's class.
    """
    defined = [(c, x) for c, source, x in Reader(store).definitions() if source == "equivalent_to"]
    people = checkpointed(store.scan("objs", p=v.TYPE, o=v.INDIVIDUAL).select("s").distinct())
    for _ in range(most_rounds):
        found = [Evaluator(store, people).satisfied_by(x).join(people, "s", "left_semi").select("s", F.lit(c).alias("o")) for c, x in defined]
        if not found:
            return store
        types = store.scan("objs", p=v.TYPE).select("s", "o")
        fresh = checkpointed(reduce(lambda a, b: a.unionByName(b), found).distinct().join(types, ["s", "o"], "left_anti"))
        if fresh.isEmpty():
            return store
        store = store.plus("objs", fresh.select(F.lit(graph).alias("c"), "s", F.lit(v.TYPE).alias("p"), "o"))
    raise RuntimeError("the definitions did not come to an end")


def infer_literals(store: QuadStore, graph: str = INFERRED) -> QuadStore:
    """The store with literals also under the properties above their own, in graph ``graph``."""
    above = closure_pairs(store.scan("objs", p=v.SUBPROPERTY).select("s", "o")).select(F.col("s").alias("p"), F.col("o").alias("q"))
    known = store.datas.columns
    new = store.datas.join(above, "p").withColumn("p", F.col("q")).withColumn("c", F.lit(graph)).select(*known).distinct()
    stated = store.datas.join(above.select(F.col("q").alias("p")).distinct(), "p", "left_semi").select("s", "p", "lex", "d", "lang")
    keys = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("s", "p", "lex", "d", "lang")]
    return store.plus("datas", new.alias("n").join(stated.alias("k"), reduce(lambda a, b: a & b, keys), "left_anti").select(*known))
