"""Catalogue views: what a store declares, each a filter on rdf:type or a small join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources.store import QuadStore
from .closure import Hierarchy, components
from .constructs import lists, restrictions


def of_type(store: QuadStore, *kinds: str) -> DataFrame:
    return store.scan("objs", p=v.TYPE, o=list(kinds)).where("NOT startswith(s, '_:')").select("s").distinct()


def classes(store: QuadStore) -> DataFrame:
    return of_type(store, v.CLASS)


def properties(store: QuadStore, kind: str | None = None) -> DataFrame:
    """Object, data or annotation properties, or all."""
    kinds = {"object": v.OBJECT_PROPERTY, "data": v.DATA_PROPERTY, "annotation": v.ANNOTATION_PROPERTY}
    return of_type(store, kinds[kind]) if kind else of_type(store, *kinds.values())


def individuals(store: QuadStore) -> DataFrame:
    return of_type(store, v.INDIVIDUAL)


def inconsistent_classes(store: QuadStore) -> DataFrame:
    """Classes equivalent to Nothing, over any number of steps."""
    same = components(store.scan("objs", p=v.EQUIVALENT_CLASS).select("s", "o"))
    bad = same.where(F.col("node") == v.NOTHING).select("component")
    return same.join(bad, "component", "left_semi").where(F.col("node") != v.NOTHING).select(F.col("node").alias("s"))


def disjoints(store: QuadStore, kind: str = "classes") -> DataFrame:
    """(grp, member): pair triples and n-ary nodes alike."""
    pair = {"classes": v.DISJOINT_WITH, "properties": v.PROPERTY_DISJOINT, "individuals": v.DIFFERENT_FROM}[kind]
    grp = F.concat_ws(" ", "s", "o")
    pairs = store.scan("objs", p=pair)
    out = pairs.select(grp.alias("grp"), F.col("s").alias("member")).unionByName(pairs.select(grp.alias("grp"), F.col("o").alias("member")))
    heads = store.scan("objs", p=[v.MEMBERS, v.DISTINCT_MEMBERS]).select(F.col("s").alias("grp"), F.col("o").alias("lst"))
    if heads.isEmpty():
        return out
    node_kind = {"classes": v.ALL_DISJOINT_CLASSES, "properties": v.ALL_DISJOINT_PROPERTIES, "individuals": v.ALL_DIFFERENT}[kind]
    nodes = store.scan("objs", p=v.TYPE, o=node_kind).select(F.col("s").alias("grp"))
    return out.unionByName(heads.join(nodes, "grp", "left_semi").join(lists(store), "lst").select("grp", F.col("item").alias("member")))


def disjoint_from(store: QuadStore, member: str, kind: str = "classes") -> DataFrame:
    both = disjoints(store, kind)
    mine = both.where(F.col("member") == member).select("grp")
    return both.join(mine, "grp", "left_semi").where(F.col("member") != member).select(F.col("member").alias("s")).distinct()


def general_axioms(store: QuadStore) -> DataFrame:
    """(s, o): anonymous classes as subjects of subClassOf that no other construct holds."""
    top = store.scan("objs", p=v.SUBCLASS).where(F.col("s").startswith("_:"))
    return top.join(store.objs.select(F.col("o").alias("s")), "s", "left_anti").select("s", "o")


def entity_kinds(store: QuadStore) -> DataFrame:
    """(s, kind): class, property or individual; a used but undeclared entity is guessed."""
    types = store.scan("objs", p=v.TYPE).where("NOT startswith(s, '_:')")
    prop = [v.OBJECT_PROPERTY, v.DATA_PROPERTY, v.ANNOTATION_PROPERTY]
    declared = types.select("s", F.when(F.col("o") == v.CLASS, 1).when(F.col("o").isin(*prop), 2).otherwise(3).alias("k"))
    used = store.scan("objs", p=v.TYPE).select(F.col("o").alias("s"), F.lit(4).alias("k")).where("NOT startswith(s, '_:')")
    supers = store.scan("objs", p=v.SUBCLASS).where("NOT startswith(s, '_:')").select("s", F.lit(4).alias("k"))
    best = declared.unionByName(used).unionByName(supers).groupBy("s").agg(F.min("k").alias("k"))
    return best.select("s", F.when(F.col("k").isin(1, 4), "class").when(F.col("k") == 2, "property").otherwise("individual").alias("kind"))


def parents(store: QuadStore, entity: str, graph: str | None = None) -> DataFrame:
    return store.scan("objs", s=entity, p=[v.SUBCLASS, v.SUBPROPERTY, v.TYPE], c=graph).select(F.col("o").alias("s")).distinct()


def children(store: QuadStore, entity: str, graph: str | None = None) -> DataFrame:
    return store.scan("objs", o=entity, p=[v.SUBCLASS, v.SUBPROPERTY], c=graph).select("s").distinct()


def direct_instances(store: QuadStore, cls: str, graph: str | None = None) -> DataFrame:
    return store.scan("objs", o=cls, p=v.TYPE, c=graph).select("s").distinct()


def used_properties(store: QuadStore) -> DataFrame:
    """(s, p) of subjects, and of objects through the inverse where there is one."""
    direct = store.quads.select("s", "p")
    if not store.inverses:
        return direct.distinct()
    table = F.create_map(*(F.lit(x) for kv in store.inverses.items() for x in kv))
    back = store.objs.select(F.col("o").alias("s"), F.try_element_at(table, F.col("p")).alias("p")).where("p IS NOT NULL")
    return direct.unionByName(back).distinct()


def class_properties(store: QuadStore) -> DataFrame:
    return restrictions(store).select("cls", "property").distinct()


def inverse_restrictions(store: QuadStore, p: str) -> DataFrame:
    """(s, cls): s is what a restriction on p of class cls is filled with."""
    return restrictions(store).where((F.col("property") == p) & F.col("filler").isNotNull()).select(F.col("filler").alias("s"), "cls").distinct()


def possible_relations(store: QuadStore) -> DataFrame:
    """(s, p): properties whose domains a subject's types all meet; ``free_properties`` has those that suit everyone."""
    domains = store.scan("objs", p=v.DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("cls"))
    up = Hierarchy(store.scan("objs", p=v.SUBCLASS)).pairs(store.objs.sparkSession)
    types = store.scan("objs", p=v.TYPE).select("s", F.col("o").alias("cls"))
    wide = types.unionByName(types.join(up.select(F.col("s").alias("cls"), F.col("o").alias("up")), "cls").select("s", F.col("up").alias("cls"))).distinct()
    met = wide.join(domains, "cls").groupBy("s", "p").agg(F.count_distinct("cls").alias("n"))
    asked = domains.groupBy("p").agg(F.count_distinct("cls").alias("k"))
    return met.join(asked, "p").where("n = k").select("s", "p")


def free_properties(store: QuadStore) -> DataFrame:
    """(p): properties without a domain."""
    return properties(store).withColumnRenamed("s", "p").join(store.scan("objs", p=v.DOMAIN).select(F.col("s").alias("p")), "p", "left_anti")


def ranges(store: QuadStore, p: str) -> DataFrame:
    """(s): the ranges of p and of the properties above it, classes and datatypes alike."""
    above = Hierarchy(store.scan("objs", p=v.SUBPROPERTY)).above(store.objs.sparkSession, [p])
    return store.scan("objs", p=v.RANGE).join(above.select(F.col("cls").alias("s")), "s", "left_semi").select(F.col("o").alias("s")).distinct()


def indirect_properties(store: QuadStore) -> DataFrame:
    """(s, p): properties in use for a subject, with those above them, and those that its classes are restricted on."""
    from .values import _ancestors

    own = used_properties(store)
    up = Hierarchy(store.scan("objs", p=v.SUBPROPERTY)).pairs(store.objs.sparkSession).select(F.col("s").alias("p"), F.col("o").alias("up"))
    types = store.scan("objs", p=v.TYPE).select("s", F.col("o").alias("cls"))
    wide = types.unionByName(types.join(_ancestors(store).select(F.col("s").alias("cls"), F.col("o").alias("up")), "cls").select("s", F.col("up").alias("cls")))
    by_class = wide.join(class_properties(store), "cls").select("s", F.col("property").alias("p"))
    return own.unionByName(own.join(up, "p").select("s", F.col("up").alias("p"))).unionByName(by_class).distinct()


def indirect_class_properties(store: QuadStore) -> DataFrame:
    """(cls, property) with what the classes above have."""
    from .values import _inherited

    return _inherited(store, class_properties(store), "property")


def imported(store: QuadStore, ontology: str) -> DataFrame:
    """(s): the ontologies that one imports, over any number of steps."""
    from .closure import reachable

    back = store.scan("objs", p=v.IMPORTS).select(F.col("o").alias("s"), F.col("s").alias("o"))
    return reachable(back, store.objs.sparkSession.createDataFrame([(ontology,)], "s string")).select("s")


def domains(store: QuadStore, p: str) -> DataFrame:
    """(s): the domains of p and of the properties above it."""
    above = Hierarchy(store.scan("objs", p=v.SUBPROPERTY)).above(store.objs.sparkSession, [p])
    return store.scan("objs", p=v.DOMAIN).join(above.select(F.col("cls").alias("s")), "s", "left_semi").select(F.col("o").alias("s")).distinct()


def metadata(store: QuadStore, ontology: str) -> DataFrame:
    return store.scan("quads", s=ontology).select("p", "o", "lex", "d", "lang")


def constructs_of(store: QuadStore, cls: str) -> DataFrame:
    """(s): named classes whose definitions mention ``cls``, found upwards through blank nodes."""
    from .closure import reachable

    spark = store.objs.sparkSession
    links = store.scan("objs", p=list(v.CONSTRUCT)).where(F.col("s").startswith("_:") | F.col("o").startswith("_:")).select("s", "o")
    return reachable(links, spark.createDataFrame([(cls,)], "s string")).where("NOT startswith(s, '_:')").select("s").distinct()
