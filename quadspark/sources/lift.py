"""Relational tables as quads, lazily.

A row is the individual ``http://t/<table>/<key>``, a scalar column a data
property, a foreign key an object property ``http://t/<name>``. Every property
is one branch of a union with its predicate as a constant, so a pattern with a
bound predicate is pruned to one scan of the columns it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from .store import QuadStore

T = "http://t/"
P = {
    name: T + name
    for name in (
        "in_nation in_region parent placed_by has_order contains supplied_by supplies mktsegment acctbal name orderstatus totalprice "
        "orderdate shipdate has_date orderpriority size retailprice text quality toxic quantity source n_chars unit_price returnflag"
    ).split()
}
INVERSES = {P["placed_by"]: P["has_order"], P["has_order"]: P["placed_by"]}


def iri(table: str, *keys: Column | str) -> Column:
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.concat(F.lit(f"{T}{table}/"), F.concat_ws("-", *parts))


def key(x: Column | str = "s") -> Column:
    """The number that ends an IRI made by ``iri``; null where none does."""
    return F.substring_index(x, "/", -1).try_cast("bigint")


def _objs(rows: DataFrame, p: str, s: Column, o: Column) -> DataFrame:
    return rows.select(F.lit("lift").alias("c"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def _datas(rows: DataFrame, p: str, s: Column, x: str, d: str, lang: Column | None = None) -> DataFrame:
    numeric = d in v.INTEGERS or d in v.DECIMALS
    num = F.col(x).cast("double") if numeric else F.lit(None).cast("double")
    return rows.select(
        F.lit("lift").alias("c"), s.alias("s"), F.lit(p).alias("p"), F.col(x).cast("string").alias("lex"), num.alias("num"), F.lit(d).alias("d"),
        (lang if lang is not None else F.lit(None).cast("string")).alias("lang"),
    )


def _branch(make, rows: DataFrame, p: str, *more) -> tuple[str, DataFrame]:
    return p, make(rows, p, *more)


def lift(spark: SparkSession, sf_dir: str) -> QuadStore:
    """All tables as one store."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation, customer, supplier = t("region"), t("nation"), t("customer"), t("supplier")
    part, orders, lineitem, documents, labels = t("part"), t("orders"), t("lineitem"), t("documents"), t("labels")
    cust, supp, nat = iri("customer", "c_custkey"), iri("supplier", "s_suppkey"), iri("nation", "n_nationkey")
    order, line_order, prt, doc = iri("order", "o_orderkey"), iri("order", "l_orderkey"), iri("part", "p_partkey"), iri("document", "doc_id")
    brand = F.concat(F.lit(T + "class/"), "p_type", F.lit("/"), "p_brand")
    kind = F.concat(F.lit(T + "class/"), "p_type")
    kinds = part.select("p_type", "p_brand").distinct()
    even, odd = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    cls = lambda name: F.lit(f"{T}class/{name}")
    objs = [
        _branch(_objs, customer, P["in_nation"], cust, iri("nation", "c_nationkey")),
        _branch(_objs, supplier, P["in_nation"], supp, iri("nation", "s_nationkey")),
        _branch(_objs, nation, P["in_region"], nat, iri("region", "n_regionkey")),
        _branch(_objs, customer.where("c_custkey > 0"), P["parent"], cust, iri("customer", F.expr("c_custkey div 2"))),
        _branch(_objs, even, P["placed_by"], order, iri("customer", "o_custkey")),
        _branch(_objs, odd, P["has_order"], iri("customer", "o_custkey"), order),
        _branch(_objs, lineitem, P["contains"], line_order, iri("part", "l_partkey")),
        _branch(_objs, lineitem, P["supplied_by"], line_order, iri("supplier", "l_suppkey")),
        _branch(_objs, customer, v.TYPE, cust, cls("Customer")),
        _branch(_objs, supplier, v.TYPE, supp, cls("Supplier")),
        _branch(_objs, orders, v.TYPE, order, cls("Order")),
        _branch(_objs, nation, v.TYPE, nat, cls("Nation")),
        _branch(_objs, region, v.TYPE, iri("region", "r_regionkey"), cls("Region")),
        _branch(_objs, part, v.TYPE, prt, brand),
        _branch(_objs, labels.where("quality = 1"), v.TYPE, doc, cls("Good")),
        _branch(_objs, labels.where("toxic = 1"), v.TYPE, doc, cls("Toxic")),
        _branch(_objs, documents, v.TYPE, doc, cls("Document")),
        _branch(_objs, kinds, v.SUBCLASS, brand, kind),
        _branch(_objs, kinds.select("p_type").distinct(), v.SUBCLASS, kind, cls("Part")),
        _branch(_objs, documents.join(documents.groupBy("text").agg(F.min("doc_id").alias("rep")), "text"), v.SAME_AS, doc, iri("document", "rep")),
    ]
    axioms = [
        ("lift", P["orderdate"], v.SUBPROPERTY, P["has_date"]), ("lift", P["shipdate"], v.SUBPROPERTY, P["has_date"]),
        ("lift", P["placed_by"], v.INVERSE_OF, P["has_order"]), ("lift", f"{T}class/Good", v.DISJOINT_WITH, f"{T}class/Toxic"),
        ("lift", P["placed_by"], v.RANGE, f"{T}class/Orderer"), ("lift", P["contains"], v.RANGE, f"{T}class/Supplied"),
    ]
    for p in sorted({a[2] for a in axioms}):
        objs.append((p, spark.createDataFrame([a for a in axioms if a[2] == p], "c string, s string, p string, o string")))
    datas = [
        _branch(_datas, customer, P["mktsegment"], cust, "c_mktsegment", v.STRING),
        _branch(_datas, customer, P["acctbal"], cust, "c_acctbal", v.DOUBLE),
        _branch(_datas, supplier, P["acctbal"], supp, "s_acctbal", v.DOUBLE),
        _branch(_datas, customer, P["name"], cust, "c_name", v.STRING),
        _branch(_datas, nation, P["name"], nat, "n_name", v.STRING),
        _branch(_datas, region, P["name"], iri("region", "r_regionkey"), "r_name", v.STRING),
        _branch(_datas, part, P["name"], prt, "p_name", v.STRING),
        _branch(_datas, part, P["size"], prt, "p_size", v.INTEGER),
        _branch(_datas, part, P["retailprice"], prt, "p_retailprice", v.DOUBLE),
        _branch(_datas, orders, P["orderstatus"], order, "o_orderstatus", v.STRING),
        _branch(_datas, orders, P["totalprice"], order, "o_totalprice", v.DOUBLE),
        _branch(_datas, orders, P["orderpriority"], order, "o_orderpriority", v.STRING),
        _branch(_datas, orders, P["orderdate"], order, "o_orderdate", v.DATETIME),
        _branch(_datas, lineitem, P["shipdate"], iri("line", "l_orderkey", "l_linenumber"), "l_shipdate", v.DATETIME),
        _branch(_datas, documents, P["text"], doc, "text", v.PLAIN, F.col("lang")),
        _branch(_datas, documents, P["source"], doc, "source", v.STRING),
        _branch(_datas, documents, P["n_chars"], doc, "n_chars", v.INTEGER),
        _branch(_datas, labels, P["quality"], doc, "quality", v.INTEGER),
        _branch(_datas, labels, P["toxic"], doc, "toxic", v.INTEGER),
    ]
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    all_objs, all_datas = union([f for _, f in objs]), union([f for _, f in datas])
    group = lambda frames: {p: [f for q, f in frames if q == p] for p, _ in frames}
    return QuadStore(all_objs, all_datas, INVERSES, {"objs": (all_objs, group(objs), ()), "datas": (all_datas, group(datas), ())})


_held: dict[tuple[str, str], QuadStore] = {}


def lifted(spark: SparkSession, sf_dir: str) -> QuadStore:
    """The tables as a store: a plan of some forty branches, kept for the session's last folder as its analysis takes seconds."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _held:
        _held.clear()
        _held[at] = lift(spark, sf_dir)
    return _held[at]
