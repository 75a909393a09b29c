"""Property values: direct, inverse, indirect, class-level and annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.store import QuadStore
from .closure import Hierarchy, closure_pairs, components, numbered
from .constructs import restrictions
from .reach import Reach


def direct(store: QuadStore, p: str) -> DataFrame:
    """(s, o) through p or its inverse."""
    return store.pairs(p)


def inverse(store: QuadStore, p: str) -> DataFrame:
    """(s, o) read backwards, declared inverse or not."""
    return store.pairs(p).select(F.col("o").alias("s"), F.col("s").alias("o"))


def literals(store: QuadStore, p: str, lang: str | None = None) -> DataFrame:
    rows = store.values(p)
    return rows.where(F.col("lang") == lang) if lang else rows


def first_value(store: QuadStore, p: str) -> DataFrame:
    """(s, o): one value for each subject of a functional property, the least."""
    return store.pairs(p).groupBy("s").agg(F.min("o").alias("o"))


def value_lists(store: QuadStore, p: str) -> DataFrame:
    return store.pairs(p).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("values"))


def subproperties(store: QuadStore, p: str) -> list[str]:
    """p and the properties beneath it; property axioms are metadata."""
    spark = store.objs.sparkSession
    return [r[0] for r in Hierarchy(store.scan("objs", p=v.SUBPROPERTY)).below(spark, [p]).collect()]


def same_classes(store: QuadStore) -> DataFrame:
    """(node, component) of individuals joined by sameAs."""
    return components(store.scan("objs", p=v.SAME_AS).select("s", "o"))


def is_kind(store: QuadStore, p: str, kind: str) -> bool:
    return store.has("objs", s=p, p=v.TYPE, o=kind)


def of_classes(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """(s, o) with each end named by the least of the individuals that are the same: a row for all of them."""
    ends = pairs.join(same.withColumnRenamed("node", "s").withColumnRenamed("component", "sc"), "s", "left").join(same.withColumnRenamed("node", "o").withColumnRenamed("component", "oc"), "o", "left")
    return ends.select(F.coalesce("sc", "s").alias("s"), F.coalesce("oc", "o").alias("o")).distinct()


def for_members(pairs: DataFrame, same: DataFrame) -> DataFrame:
    """The pairs spelled out for all individuals that are the same, on either end: members times members rows."""
    left, right = same.select(F.col("node").alias("s"), F.col("component").alias("sc")), same.select(F.col("node").alias("o"), F.col("component").alias("oc"))
    by_class = pairs.join(left, "s", "left").join(right, "o", "left").select(F.coalesce("sc", "s").alias("sc"), F.coalesce("oc", "o").alias("oc")).distinct()
    out = by_class.join(left.withColumnRenamed("s", "ns"), "sc", "left").select(F.coalesce("ns", "sc").alias("s"), "oc")
    return out.join(right.withColumnRenamed("o", "no"), "oc", "left").select("s", F.coalesce("no", "oc").alias("o")).distinct()


def indirect(store: QuadStore, p: str, members: bool = False) -> DataFrame:
    """(s, o) of an object property with subproperties, inverses, sameAs, transitivity, reflexivity and class values.

    Set-at-a-time for all subjects. Individuals that are the same have one row,
    under the least name (``same_classes`` has the membership); with ``members``
    every name gets its own rows. Chains are not applied.
    """
    names = subproperties(store, p)
    back = [i for n in names if (i := store.inverses.get(n))]
    forward = store.scan("objs", p=names).select("s", "o")
    pairs = forward.unionByName(store.scan("objs", p=back).select(F.col("o").alias("s"), F.col("s").alias("o"))) if back else forward
    per_class = class_values(store, names).select("cls", F.col("filler").alias("o"))
    if not per_class.isEmpty():
        pairs = pairs.unionByName(_class_members(store).join(per_class, "cls").select("s", "o"))
        pairs = pairs.unionByName(per_class.select(F.col("cls").alias("s"), "o"))
    same = same_classes(store)
    pairs = of_classes(pairs, same)
    if is_kind(store, p, v.TRANSITIVE):
        if is_kind(store, p, v.SYMMETRIC):
            pairs = pairs.unionByName(pairs.select(F.col("o").alias("s"), F.col("s").alias("o")))
        pairs = closure_pairs(pairs)
    if is_kind(store, p, v.REFLEXIVE):
        nodes = store.scan("objs", p=v.TYPE, o=v.INDIVIDUAL).select("s")
        pairs = pairs.unionByName(of_classes(nodes.select("s", F.col("s").alias("o")), same))
    return for_members(pairs, same) if members else pairs.distinct()


def functional_value(store: QuadStore, p: str) -> DataFrame:
    """(s, o): one value of a functional property for each subject, the most specific.

    A subject's own value comes before those of its classes, and a class's before
    those of the classes above it; of equals the least.
    """
    own = first_value(store, p)
    view = restrictions(store).where((F.col("property") == p) & F.col("kind").isin("some", "value") & F.col("filler").isNotNull())
    per_class = view.groupBy("cls").agg(F.min("filler").alias("o"))
    above = _ancestors(store)
    reach = above.unionByName(per_class.select(F.col("cls").alias("s"), F.col("cls").alias("o"))).distinct()
    types = _class_members(store).join(reach.select(F.col("s").alias("cls"), F.col("o").alias("up")), "cls").select("s", F.col("up").alias("cls")).distinct()
    met = types.join(per_class.select("cls"), "cls", "left_semi")
    best = most_specific(met, above).join(per_class, "cls").groupBy("s").agg(F.min("o").alias("o"))
    return own.unionByName(best.join(own.select("s"), "s", "left_anti"))


def class_ancestors(store: QuadStore, include_self: bool = True, constructs: bool = False) -> DataFrame:
    """(s, o): every class with those above it, through equivalents; ``constructs`` brings the anonymous ones directly above these."""
    pairs = _ancestors(store)
    names = pairs.select("s").unionByName(pairs.select(F.col("o").alias("s"))).unionByName(store.scan("objs", p=v.TYPE, o=v.CLASS).select("s")).distinct()
    own = names.select("s", F.col("s").alias("o"))
    full = pairs.unionByName(own).distinct()
    out = full if include_self else full.where("s <> o")
    if constructs:
        anonymous = store.scan("objs", p=[v.SUBCLASS, v.EQUIVALENT_CLASS]).where("startswith(o, '_:')").select(F.col("s").alias("m"), F.col("o").alias("node"))
        out = out.unionByName(full.withColumnRenamed("o", "m").join(anonymous, "m").select("s", F.col("node").alias("o")).distinct())
    return out


def are_subclasses(store: QuadStore, pairs: DataFrame) -> DataFrame:
    """(s, o): those pairs of classes of which s is o, beneath it or equivalent to such a class; all tested at once."""
    same = store.scan("objs", p=v.EQUIVALENT_CLASS).select("s", "o")
    edges = store.scan("objs", p=v.SUBCLASS).select("s", "o").unionByName(same).unionByName(same.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return Reach.build(edges).holds(pairs)


def is_subclass(store: QuadStore, cls: str, of: str) -> bool:
    """Whether a class is another, beneath it or equivalent to it."""
    return cls == of or not _ancestors(store).where((F.col("s") == cls) & (F.col("o") == of)).isEmpty()


def class_only(store: QuadStore, names: list[str]) -> DataFrame:
    """(cls, fillers): what all values must be, the intersection of the inherited ``only`` fillers, sorted."""
    return class_values(store, names, "only").groupBy("cls").agg(F.array_sort(F.collect_set("filler")).alias("fillers"))


def transitive_class_values(store: QuadStore, names: list[str]) -> DataFrame:
    """(cls, filler) of a transitive property: from class to filler, the filler's own fillers, and so on."""
    steps = class_values(store, names).select(F.col("cls").alias("s"), F.col("filler").alias("o"))
    return closure_pairs(steps).select(F.col("s").alias("cls"), F.col("o").alias("filler"))


def indirect_literals(store: QuadStore, p: str, annotation: bool = False) -> DataFrame:
    """(s, lex): with subproperties, and for data properties through sameAs and class values; annotations are not shared."""
    names = subproperties(store, p)
    own = store.values(names).select("s", "lex")
    if annotation:
        return own.distinct()
    per_class = restrictions(store).where(F.col("property").isin(*names) & F.col("filler_lex").isNotNull()).select("cls", F.col("filler_lex").alias("lex"))
    own = own.unionByName(_class_members(store).join(_inherited(store, per_class, "lex"), "cls").select("s", "lex"))
    same = same_classes(store)
    with_class = own.join(same.withColumnRenamed("node", "s"), "s", "left").select(F.coalesce("component", "s").alias("component"), "lex").distinct()
    return with_class.join(same, "component", "left").select(F.coalesce("node", "component").alias("s"), "lex").distinct()


def _ancestors(store: QuadStore) -> DataFrame:
    """(s, o): class s is o, beneath it or equivalent."""
    links = store.scan("objs", p=v.SUBCLASS).select("s", "o").where("NOT startswith(o, '_:')")
    same = store.scan("objs", p=v.EQUIVALENT_CLASS).select("s", "o").where("NOT startswith(o, '_:')")
    all_links = links.unionByName(same).unionByName(same.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return Hierarchy(all_links).pairs(store.objs.sparkSession)


def _inherited(store: QuadStore, per_class: DataFrame, value: str) -> DataFrame:
    """(cls, value) with what ancestors and equivalents have."""
    passed = _ancestors(store).withColumnRenamed("o", "cls").join(per_class, "cls").select(F.col("s").alias("cls"), value)
    return per_class.unionByName(passed).distinct()


def _class_members(store: QuadStore) -> DataFrame:
    return store.scan("objs", p=v.TYPE).select("s", F.col("o").alias("cls"))


def class_values(store: QuadStore, names: list[str], kind: str = "some") -> DataFrame:
    """(cls, filler) of some, value, exactly and min restrictions (or of ``only``), with the ancestors'."""
    kinds = ["only"] if kind == "only" else ["some", "value"]
    view = restrictions(store).where(F.col("property").isin(*names) & F.col("filler").isNotNull() & ~F.col("inverse"))
    chosen = view.where(F.col("kind").isin(*kinds) | ((F.lit(kind) == "some") & F.col("kind").isin("exactly", "min") & (F.col("cardinality") >= 1)))
    return _inherited(store, chosen.select("cls", "filler").distinct(), "filler")


def most_specific(types: DataFrame, below: DataFrame) -> DataFrame:
    """(s, cls) without classes that have another class of the same subject beneath them; ``below`` is (s, o)."""
    lower = types.select("s", F.col("cls").alias("low")).join(below.select(F.col("s").alias("low"), F.col("o").alias("cls")), "low").select("s", "cls")
    return types.join(lower, ["s", "cls"], "left_anti")


def annotations(store: QuadStore, annotation: str | None = None) -> DataFrame:
    """(axiom, s, p, o, o_lex, annotation, lex, num) of annotated triples: a star of equi-joins on the axiom node."""
    part = lambda p, name: store.scan("objs", p=p).select(F.col("s").alias("axiom"), F.col("o").alias(name))
    targets = part(v.TARGET, "o").withColumn("o_lex", F.lit(None).cast("string")).unionByName(
        store.scan("datas", p=v.TARGET).select(F.col("s").alias("axiom"), F.lit(None).cast("string").alias("o"), F.col("lex").alias("o_lex"))
    )
    star = part(v.SOURCE, "s").join(part(v.PROPERTY, "p"), "axiom").join(targets, "axiom")
    notes = store.scan("datas", p=annotation) if annotation else store.datas.where(~F.col("p").isin(v.SOURCE, v.PROPERTY, v.TARGET, v.TYPE))
    return star.join(notes.select(F.col("s").alias("axiom"), F.col("p").alias("annotation"), "lex", "num"), "axiom")


def annotate(rows: DataFrame, annotation: str, graph: str) -> tuple[DataFrame, DataFrame]:
    """(objs, datas) that annotate the triples ``rows`` (s, p, o, lex, num, d); one axiom node for each triple."""
    node = F.concat(F.lit("_:ax"), F.hex(F.xxhash64("s", "p", "o")))
    keyed = rows.withColumn("axiom", node)
    parts = [(v.TYPE, F.lit(v.AXIOM)), (v.SOURCE, F.col("s")), (v.PROPERTY, F.col("p")), (v.TARGET, F.col("o"))]
    objs = reduce(lambda a, b: a.unionByName(b), [keyed.select(F.lit(graph).alias("c"), F.col("axiom").alias("s"), F.lit(p).alias("p"), x.alias("o")) for p, x in parts]).distinct()
    datas = keyed.select(F.lit(graph).alias("c"), F.col("axiom").alias("s"), F.lit(annotation).alias("p"), "lex", "num", "d", F.lit(None).cast("string").alias("lang"))
    return objs, datas


def instances_ordered(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, label, pos): instances by label, nulls first, then by name."""
    joined = instances.join(labels.groupBy("s").agg(F.min("lex").alias("label")), "s", "left").select("s", "label")
    return numbered(joined, F.asc_nulls_first("label"), "s")
