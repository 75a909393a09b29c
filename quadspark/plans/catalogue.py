"""Queries over the lifted tables; each key has its oracle in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import closing, closure, constructs, diff, fts, mutate, reason, rules, terminology, values
from ..operators.bgp import Pattern
from ..operators.constructs import Evaluator, Facets, Named, Property
from ..operators.search import FTS, Iri, NumS, Or, both, either, search
from ..sources import ntriples, rrf
from ..sources.lift import P, T, _objs, iri, key, lifted
from ..sources.store import QuadStore
from ..streaming import changes
from . import inference, views  # noqa: F401
from .oracles import ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Registers f(store), f(store, spark, sf_dir) under its name."""
    n = f.__code__.co_argcount
    QUERIES[f.__name__] = lambda spark, sf_dir: f(*(lifted(spark, sf_dir), spark, sf_dir)[:n])
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cls(name: str) -> str:
    return f"{T}class/{name}"


def keys(rows: DataFrame) -> DataFrame:
    return rows.select(key("s").alias("s"))


def key_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(key("s").alias("s"), key("o").alias("o"))


def number_set(spark: SparkSession, *n: int, name: str = "s") -> DataFrame:
    return spark.createDataFrame([(x,) for x in n], f"{name} bigint")


# ---- patterns ----------------------------------------------------------------
@query
def pat_obj_scan(store):
    rows = store.scan("objs", p=P["in_nation"]).where(F.col("s").startswith(f"{T}customer/"))
    return rows.select(key("s").alias("s"), key("o").cast("int").alias("o"))


@query
def pat_data_exact(store):
    return keys(store.scan("datas", p=P["mktsegment"], lex="BUILDING"))


@query
def pat_predicate_counts(store):
    wanted = [P[x] for x in ("mktsegment", "orderstatus", "retailprice")]
    counts = store.scan("datas", p=wanted).groupBy("p").agg(F.count("*").alias("n"))
    return counts.select(F.substring_index("p", "/", -1).alias("p"), "n")


@query
def pat_inverse_union(store):
    return key_pairs(store.pairs(P["has_order"]))


@query
def pat_punned(store):
    nation = store.scan("objs", p=P["in_nation"])
    kinds = [nation.where(F.col("s").startswith(f"{T}{t}/")).select(F.lit("lift").alias("c"), F.col("o").alias("s"), F.lit(v.TYPE).alias("p"), F.lit(o).alias("o")) for t, o in (("supplier", v.CLASS), ("customer", v.INDIVIDUAL))]
    return QuadStore(kinds[0].unionByName(kinds[1]), store.datas).punned().select(key("s").cast("int").alias("s"))


# ---- search ------------------------------------------------------------------
@query
def search_type(store):
    return keys(search(store, type=cls("ECONOMY")))


@query
def search_subclass_of(store):
    return search(store, subclass_of=cls("ECONOMY")).select(F.substring("s", len(cls("")) + 1, 100).alias("s"))


@query
def search_is_a(store):
    out = search(store, is_a=cls("ECONOMY"))
    return out.select(F.regexp_replace("s", f"^{T}(class/)?", "").alias("s"))


@query
def search_subproperty(store):
    dates = [r[0] for r in search(store, subproperty_of=P["has_date"]).collect()]  # properties are metadata
    return store.values(dates).select(F.when(F.col("p") == P["orderdate"], "orders").otherwise("lineitem").alias("src"), F.split(F.substring_index("s", "/", -1), "-")[0].cast("bigint").alias("s"), F.col("lex").cast("timestamp_ntz").alias("d"))


@query
def search_or_class(store):
    return keys(search(store, type=Or([cls("ECONOMY"), cls("PROMO")])))


def _named_iris(store: QuadStore) -> QuadStore:
    """Customers known by their names as IRIs."""
    rows = store.scan("datas", p=P["name"]).where(F.col("s").startswith(f"{T}customer/"))
    return QuadStore(rows.select("c", F.col("lex").alias("s"), F.lit(P["in_nation"]).alias("p"), F.col("s").alias("o")), store.datas)


@query
def search_iri_glob(store):
    named = _named_iris(store)
    return search(named, iri="*#00000012*").join(named.objs, "s").select(key("o").alias("s"))


@query
def search_iri_nocase(store):
    named = _named_iris(store)
    return search(named, iri="*customer#00000001*", case_sensitive=False).join(named.objs, "s").select(key("o").alias("s"))


def _parts(found: DataFrame) -> DataFrame:
    return keys(found.where(F.col("s").startswith(f"{T}part/")))


@query
def search_text_glob(store):
    return _parts(search(store, {P["name"]: "red*"}))


@query
def search_text_nocase(store):
    return _parts(search(store, {P["name"]: "*WIDGET*"}, case_sensitive=False))


@query
def search_nums(store):
    return keys(search(store, {P["size"]: NumS(">", 10, "<=", 20)}))


@query
def search_all_values(store, spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    supplies = QuadStore(_objs(line, P["supplies"], iri("supplier", "l_suppkey"), iri("part", "l_partkey")), store.datas)
    return keys(search(supplies, {P["supplies"]: [Iri(f"{T}part/10"), Iri(f"{T}part/11")]}))


@query
def search_wildcard(store):
    return keys(search(store, {P["text"]: "*", P["quality"]: "*"}))


@query
def search_none(store):
    return keys(search(store, {P["text"]: "*", P["quality"]: None}))


@query
def search_nested(store):
    nations = search(store, {P["in_region"]: Iri(f"{T}region/2")})
    people = search(store, {P["mktsegment"]: "BUILDING", P["in_nation"]: nations})
    return keys(search(store, {P["placed_by"]: people}))


@query
def search_nested_union(store):
    people = either(search(store, {P["mktsegment"]: "BUILDING"}), search(store, type=cls("Customer"), **{P["acctbal"]: NumS("<", 0)}))
    return keys(search(store, {P["placed_by"]: people}))


@query
def search_union(store):
    return keys(either(search(store, {P["size"]: NumS("<", 5)}), search(store, type=cls("PROMO"))))


@query
def search_intersect(store):
    return keys(both(search(store, {P["size"]: NumS("<", 5)}), search(store, type=cls("PROMO"))))


@query
def search_count(store):
    return search(store, type=cls("PROMO"), **{P["size"]: NumS("<", 25)}).agg(F.count("*").alias("n"))


@query
def search_flagship(store):
    nations = search(store, {P["in_region"]: Iri(f"{T}region/2")})
    people = search(store, type=cls("Customer"), **{P["in_nation"]: nations, P["acctbal"]: NumS(">", 5000)})
    urgent = search(store, {P["orderpriority"]: "1-URGENT", P["orderstatus"]: "P"})
    return keys(people.join(search(store, {P["has_order"]: urgent}), "s", "left_anti"))


# ---- full text -----------------------------------------------------------------
@query
def fts_and(store):
    return keys(search(store, {P["text"]: FTS("the and")}))


@query
def fts_prefix(store):
    return keys(search(store, {P["text"]: FTS("eau*")}))


@query
def fts_lang(store):
    return keys(search(store, {P["text"]: FTS("la", "fr")}))


@query
def fts_bm25(store):
    scored = fts.bm25(store.values(P["text"]), "ouen").select(key("s").alias("s"), F.round("bm25", 6).alias("bm25"))
    return scored.orderBy("bm25", "s").limit(20)


# ---- closures --------------------------------------------------------------------
@query
def closure_ancestors(store):
    return key_pairs(closure.closure_pairs(store.pairs(P["parent"])))


@query
def closure_descendants(store, spark):
    seed = spark.createDataFrame([(f"{T}customer/3",)], "s string")
    return closure.reachable(store.pairs(P["parent"]), seed).select(key("s").alias("s"), "depth")


@query
def closure_cyclic(store, spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), F.expr("(c_custkey div 60) * 60 + (c_custkey * 7 + 1) % 60").alias("o"))
    return closure.closure_pairs(edges)


@query
def closure_equivalence(store):
    docs = store.scan("objs", p=v.TYPE, o=cls("Document")).select(key("s").alias("s"))
    parts = closure.components(key_pairs(store.scan("objs", p=v.SAME_AS)))
    return docs.join(parts, F.col("s") == F.col("node"), "left").select("s", F.coalesce("component", "s").alias("rep"))


@query
def closure_multi_property(store):
    located = store.pairs(P["in_nation"]).where(F.col("s").startswith(f"{T}customer/"))
    pairs = closure.multi_property([located, store.pairs(P["in_region"])])
    return pairs.where(F.col("s").startswith(f"{T}customer/")).select(key("s").alias("s"), F.substring("o", len(T) + 1, 100).alias("o"))


@query
def rdf_list_order(store, spark, sf_dir):
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = line.select(F.concat(F.lit("_:list"), "l_orderkey").alias("lst"), F.row_number().over(w).alias("pos"), F.col("l_partkey").cast("string").alias("item"))
    found = constructs.lists(QuadStore(closure.stored(mutate.list_rows(items, "lift"), "lists"), store.datas))
    return found.select(F.substring("lst", 7, 30).cast("bigint").alias("lst"), "pos", F.col("item").cast("bigint").alias("item"))


@query
def root_classes(store):
    edges = store.scan("objs", p=v.SUBCLASS).where(F.col("o") != cls("Part"))
    return closure.roots(edges).select(F.substring("s", len(cls("")) + 1, 100).alias("s"))


@query
def most_specific(store, spark):
    h = closure.Hierarchy(store.scan("objs", p=v.SUBCLASS))
    below = h.pairs(spark)
    asserted = store.scan("objs", p=v.TYPE).where(F.col("s").startswith(f"{T}part/")).select("s", F.col("o").alias("cls"))
    inferred = asserted.join(below.select(F.col("s").alias("cls"), "o"), "cls").select("s", F.col("o").alias("cls"))
    kept = values.most_specific(asserted.unionByName(inferred).distinct(), below)
    return kept.select(key("s").alias("s"), F.substring("cls", len(cls("")) + 1, 100).alias("cls"))


@query
def lca(store):
    edges = key_pairs(store.pairs(P["parent"])).where("o > 0")
    return terminology.lowest_common_ancestors(edges, [70, 71, 145]).select(F.col("s").cast("int").alias("s"))


@query
def complete_families(store):
    edges = store.scan("objs", p=v.SUBCLASS).where(F.col("o") != cls("Part")).select("s", "o")
    found = terminology.complete_families(edges, edges.select("s"), 25)
    return found.select(F.substring("parent", len(cls("")) + 1, 100).alias("parent"))


@query
def term_mapping(store):
    docs = store.values(P["text"]).select(F.col("s"), F.col("lex").alias("concept")).join(store.values(P["source"]).select("s", F.col("lex").alias("src")), "s")
    codes = docs.select(F.struct(key("s").alias("id"), "src").alias("code"), "concept")
    sources = docs.select(F.col("src").alias("code"), "concept").distinct()  # few for each concept, however many copies it has
    return terminology.map_through(codes, sources).where("src.src <> dst").select(F.col("src.id").alias("src"), "dst").distinct()


# ---- values and class expressions ---------------------------------------------------
@query
def reified_annotation(store, spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    node = F.concat(F.lit("_:ax"), F.concat_ws("-", "l_orderkey", "l_linenumber", F.hex(F.xxhash64(*line.columns))))
    parts = [(v.TYPE, F.lit(v.AXIOM)), (v.SOURCE, iri("order", "l_orderkey")), (v.PROPERTY, F.lit(P["contains"])), (v.TARGET, iri("part", "l_partkey"))]
    objs = None
    for p, o in parts:
        objs = _objs(line, p, node, o) if objs is None else objs.unionByName(_objs(line, p, node, o))
    datas = line.select(F.lit("lift").alias("c"), node.alias("s"), F.lit(P["quantity"]).alias("p"), F.col("l_quantity").cast("string").alias("lex"), F.col("l_quantity").alias("num"), F.lit(v.DOUBLE).alias("d"), F.lit(None).cast("string").alias("lang"))
    return values.annotations(QuadStore(objs, datas), P["quantity"]).select(key("s").alias("s"), key("o").alias("o"), F.col("num").alias("qty"))


@query
def property_chain(store):
    chain = Property(chain=(~Property(P["supplied_by"]), Property(P["placed_by"])))
    return key_pairs(constructs.edges(store, chain))


def _orders(store: QuadStore) -> Evaluator:
    return Evaluator(store, store.scan("objs", p=v.TYPE, o=cls("Order")).select("s"))


@query
def restr_some(store):
    return keys(_orders(store).satisfied_by(Property(P["contains"]).some(Named(cls("PROMO")))))


@query
def restr_only(store, spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem")
    lines = flags.select(F.lit("lift").alias("c"), iri("order", "l_orderkey").alias("s"), F.lit(P["returnflag"]).alias("p"), F.col("l_returnflag").alias("lex"), F.lit(None).cast("double").alias("num"), F.lit(v.STRING).alias("d"), F.lit(None).cast("string").alias("lang"))
    ev = Evaluator(QuadStore(store.objs, lines), store.scan("objs", p=v.TYPE, o=cls("Order")).select("s"))
    return keys(ev.satisfied_by(Property(P["returnflag"]).only(Facets(pattern="N"))))


@query
def restr_min(store):
    return keys(_orders(store).satisfied_by(Property(P["contains"]).min(6)))


@query
def restr_exactly(store):
    return keys(_orders(store).satisfied_by(Property(P["contains"]).exactly(0)))


@query
def class_expr(store):
    parts = Evaluator(store, search(store, type=cls("Part")))
    brands = [r[0] for r in store.scan("objs", p=v.SUBCLASS).where("endswith(s, '/Brand#1') OR endswith(s, '/Brand#2')").select("s").collect()]  # classes are metadata
    branded = Named(brands[0])
    for b in brands[1:]:
        branded = branded | Named(b)
    return keys(parts.satisfied_by((Named(cls("PROMO")) | (Property(P["size"]) < 5)) & ~branded))


@query
def facets(store):
    parts = Evaluator(store, search(store, type=cls("Part")))
    named = Property(P["name"]).some(Facets(max_length=9, pattern="[a-z]+ [a-z]+"))
    priced = Property(P["retailprice"]).some(Facets(min_inclusive=950, max_exclusive=1200))
    return keys(parts.satisfied_by(named & priced))


@query
def close_world(store):
    orders = store.scan("objs", p=P["contains"]).select("s").distinct()
    closed = closing.close_individuals(store, [P["contains"]], orders)
    members = F.array_sort(F.transform("members", lambda x: F.substring_index(x, "/", -1)))
    return closed.select(key("s").alias("s"), F.array_join(members, ",").alias("fillers"))


# ---- reasoning and rules -----------------------------------------------------------
@query
def infer_domain_range(store):
    both_ways = QuadStore(
        store.scan("objs", p=[P["contains"], v.RANGE, v.DOMAIN]).unionByName(store.pairs(P["placed_by"]).select(F.lit("lift").alias("c"), "s", F.lit(P["placed_by"]).alias("p"), "o")),
        store.datas.where(F.col("p") == P["placed_by"]),
    )
    found = reason.domain_range_types(both_ways)
    return found.select(F.substring("cls", len(cls("")) + 1, 100).alias("cls"), key("s").alias("s"))


@query
def infer_new_relations(store):
    body = [rules.Obj(P["placed_by"], "?o", "?c"), rules.Obj(P["supplied_by"], "?o", "?p")]
    derived, _ = rules.consequences(store, rules.Rule(body, [rules.Obj(P["supplies"], "?c", "?p")]))
    return key_pairs(reason.new_relations(derived.select("s", "o"), store.pairs(P["supplies"])))


@query
def violations(store):
    return keys(reason.violations(store).where("kind = 'disjoint'"))


@query
def swrl_arith(store, spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    row = F.concat(iri("line", "l_orderkey"), F.lit("/"), F.concat_ws("-", F.monotonically_increasing_id(), "l_linenumber"))
    number = lambda p, x: line.select(F.lit("lift").alias("c"), row.alias("s"), F.lit(P[p]).alias("p"), F.col(x).cast("string").alias("lex"), F.col(x).alias("num"), F.lit(v.DOUBLE).alias("d"), F.lit(None).cast("string").alias("lang"))
    lines = closure.checkpointed(number("totalprice", "l_extendedprice").unionByName(number("quantity", "l_quantity")))
    rule = rules.Rule([rules.Data(P["totalprice"], "?x", "?e"), rules.Data(P["quantity"], "?x", "?q"), rules.Builtin("divide", "?u", "?e", "?q")], [rules.Data(P["unit_price"], "?x", "?u")])
    _, datas = rules.consequences(QuadStore(store.objs, lines), rule)
    parts = F.split("s", "/")
    return datas.select(parts[4].cast("bigint").alias("s"), F.substring_index("s", "-", -1).cast("int").alias("ln"), (F.round(F.col("num") * 10_000) / 10_000).alias("unit_price"))


@query
def swrl_matches(store):
    rule = rules.Rule([rules.Data(P["name"], "?x", "?n"), rules.Builtin("matches", "?n", "re.*")], [rules.Cls(cls("Re"), "?x")])
    objs, _ = rules.consequences(store, rule)
    return _parts(objs)


# ---- graph patterns ----------------------------------------------------------------
@query
def sparql_bgp(store):
    p = Pattern(store).triple("?c", P["in_nation"], "?n").data("?c", P["acctbal"], "?b", as_number=True).triple("?c", v.TYPE, cls("Customer"))
    p = p.filter(F.col("b") > 9000).data("?c", P["name"], "?customer").data("?n", P["name"], "?nation")
    return p.select("customer", "nation")


@query
def sparql_optional(store):
    p = Pattern(store).triple("?doc", v.TYPE, cls("Document")).optional(Pattern(store).data("?doc", P["quality"], "?quality", as_number=True))
    return p.select("doc", "quality").select(key("doc").alias("doc"), F.col("quality").cast("int").alias("quality"))


@query
def sparql_group(store):
    p = Pattern(store).triple("?c", v.TYPE, cls("Customer")).triple("?c", P["in_nation"], "?n").triple("?n", P["in_region"], "?r").data("?r", P["name"], "?region")
    return p.group(["region"], n=F.count("*"))


@query
def sparql_minus(store):
    p = Pattern(store).data("?doc", P["source"], "?source").minus(Pattern(store).data("?doc", P["toxic"], 1))
    return p.select("source", "doc", distinct=True).select("source", key("doc").alias("doc"))


# ---- changes -----------------------------------------------------------------------
@query
def mut_delete(store, spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    quads = line.select(F.col("l_suppkey").cast("string").alias("c"), iri("order", "l_orderkey").alias("s"), F.concat(F.lit(P["contains"] + "/"), "l_returnflag").alias("p"), iri("part", "l_partkey").alias("o"))
    left = mutate.delete(QuadStore(quads, store.datas), F.col("p") == P["contains"] + "/R").objs
    return left.select(key("s").alias("s"), key("o").alias("o"), F.col("c").cast("bigint").alias("c"))


@query
def mut_refactor(store):
    names = store.scan("datas", p=P["name"]).where(F.col("s").startswith(f"{T}nation/"))
    as_iris = QuadStore(names.select("c", F.col("lex").alias("s"), F.lit(P["name"]).alias("p"), F.col("s").alias("o")), store.datas.limit(0))
    renaming = names.select(F.col("lex").alias("old"), F.replace(F.col("lex"), F.lit("NATION_"), F.lit("COUNTRY_")).alias("new"))
    return mutate.refactor(as_iris, renaming).objs.select(key("o").cast("int").alias("s"), F.col("s").alias("iri"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("s"), F.col("event_type").alias("p"), F.col("value").alias("o"))


@query
def observe_collapsed(store, spark, sf_dir):
    return changes.collapsed(_log(spark, sf_dir)).withColumn("scan", F.col("scan").cast("timestamp_ntz"))


@query
def instances_ordered(store):
    small = search(store, type=cls("SMALL")).select(key("s").alias("s"))
    names = store.values(P["name"]).where(F.col("s").startswith(f"{T}part/")).select(key("s").alias("s"), "lex")
    return values.instances_ordered(small, names).select("s", "pos")


@query
def next_numbered_iri(store):
    return mutate.next_number(store.scan("datas", p=P["name"]).where(F.col("s").startswith(f"{T}customer/")), "lex")


@query
def export_ntriples(store):
    return ntriples.lines(QuadStore(store.scan("objs", p=P["in_region"]), store.datas.where("false")))


@query
def rrf_fill_down(store, spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("s"), "turn", F.when(F.col("role") == "user", F.col("turn")).alias("prev"))
    return rrf.fill_down(turns, ["prev"], ["s"], ["turn"])


@query
def rrf_preferred_label(store, spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rrf.preferred(docs, "source", "doc_id", -F.col("n_chars"), F.col("doc_id"))


@query
def interval_parent(store, spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s"))
    groups = parts.select(F.expr("(s div 100) * 100").alias("parent")).distinct().select("parent", F.col("parent").alias("low"), (F.col("parent") + 99).alias("high"))
    return rrf.interval_parents(parts, groups, 100)


@query
def parent_votes(store, spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("s"), F.col("event_type").alias("p"))
    return terminology.parent_votes(events, "s", "p")


for _name, _query in views.QUERIES.items():
    QUERIES[_name] = _query
ORACLE_SQL = ORACLE_SQL | views.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
