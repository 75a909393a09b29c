"""Keyword-criteria search over a store.

    search(store, type=C, price=NumS(">", 5), has_topping=None)

Criteria on one subject are chained semi-joins; absence is an anti-join against
the union of all absent conditions; a property with an inverse is read in both
directions by a union. Results are DataFrames with the one column ``s``, so they
nest as values, and combine with ``|`` and ``&`` as ``either`` and ``both``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.terms import Loc, literal_lex, matches_glob
from ..sources.store import QuadStore
from . import fts
from .closure import hierarchy

_TESTS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "!=": "__ne__"}
_HIERARCHY = {"type": (v.SUBCLASS,), "subclass_of": (v.SUBCLASS,), "is_a": (v.SUBCLASS, v.TYPE), "subproperty_of": (v.SUBPROPERTY,)}


class NumS:
    """Numeric conditions that one value must meet together: NumS(">", 5, "<=", 9)."""

    def __init__(self, *conditions: object):
        self.tests = list(zip(conditions[::2], conditions[1::2], strict=True))

    def column(self, x):
        return reduce(lambda a, b: a & b, [getattr(x, _TESTS[op])(value) for op, value in self.tests])


@dataclass
class FTS:
    query: str
    lang: str | None = None


@dataclass(frozen=True)
class Iri:
    """An entity as a value, apart from text."""

    iri: str


class Or(list):
    """Several classes of which any will do."""


def _hierarchy_criterion(store: QuadStore, key: str, value: object, cache: dict) -> DataFrame:
    spark = store.objs.sparkSession
    if isinstance(value, DataFrame):  # a nested search: direct links only
        link = v.TYPE if key == "type" else v.SUBPROPERTY if key == "subproperty_of" else [v.SUBCLASS, v.TYPE] if key == "is_a" else v.SUBCLASS
        return store.scan("objs", p=link).join(value.select(F.col(value.columns[0]).alias("o")), "o", "left_semi").select("s")
    names = [x.iri if isinstance(x, Iri) else x for x in (value if isinstance(value, Or) else [value])]
    edge = v.SUBPROPERTY if key == "subproperty_of" else v.SUBCLASS
    if edge not in cache:
        cache[edge] = hierarchy(store, edge)
    few = cache[edge].names_below(names)
    below = cache[edge].below(spark, names)
    if few is not None:  # a filter on constants prunes the branches and files that cannot hold them
        instances = store.scan("objs", p=v.TYPE, o=few).select("s")
    else:
        instances = store.scan("objs", p=v.TYPE).join(below.select(F.col("cls").alias("o")), "o", "left_semi").select("s")
    if key == "type":
        return instances
    named = below.select(F.col("cls").alias("s"))
    if key == "is_a":
        named = named.unionByName(instances)
    return named.join(store.objs.select("s"), "s", "left_semi")


def _value_criterion(store: QuadStore, p: str, value: object, case_sensitive: bool, as_loc: bool) -> DataFrame:
    """(s) with a value of ``p`` that meets the criterion."""
    if isinstance(value, Iri):
        back = store.inverses.get(p)
        out = store.scan("objs", p=p, o=value.iri).select("s")
        return out if not back else out.unionByName(store.scan("objs", p=back, s=value.iri).select(F.col("o").alias("s")))
    if isinstance(value, DataFrame):
        return store.pairs(p).join(value.select(F.col(value.columns[0]).alias("o")), "o", "left_semi").select("s")
    datas = store.values(p)
    if isinstance(value, NumS):
        return datas.where(value.column(F.col("num"))).select("s")
    if isinstance(value, FTS):
        return fts.find(datas, value.query, value.lang).select("s")
    if isinstance(value, str) and value == "*":
        return store.pairs(p).select("s").unionByName(datas.select("s"))
    if isinstance(value, str) and "*" in value or isinstance(value, str) and not case_sensitive:
        return datas.where(matches_glob(F.col("lex"), value, case_sensitive)).select("s")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return datas.where(F.col("num") == value).select("s")
    lex, d, lang = literal_lex(value)
    found = datas.where(F.col("lex") == lex)
    if isinstance(value, Loc):
        found = found.where(F.col("lang") == lang)
    elif not isinstance(value, str):
        found = found.where(F.col("d") == d)
    elif not as_loc:
        found = found.where((F.col("d") == d) & F.col("lang").isNull())
    return found.select("s")


def search(store: QuadStore, criteria: dict | None = None, *, case_sensitive: bool = True, use_str_as_loc: bool = True, graph: str | None = None, **more: object) -> DataFrame:
    """(s): subjects that meet all criteria.

    Keys: ``iri``, ``type``, ``subclass_of``, ``is_a``, ``subproperty_of`` or a
    property. Values: a class or Or([...]); Iri, literal, text with ``*``, NumS,
    FTS, a nested result, a list (each of them), ``"*"`` (any) or None (absent).
    """
    store = store.graph(graph) if graph else store
    wanted: list[DataFrame] = []
    absent: list[DataFrame] = []
    cache: dict = {}
    for key, value in {**(criteria or {}), **more}.items():
        if key == "iri":
            wanted.append(store.objs.where(matches_glob(F.col("s"), value, case_sensitive)).select("s"))
        elif key in _HIERARCHY:
            wanted.append(_hierarchy_criterion(store, key, value, cache))
        elif value is None:
            absent += [store.pairs(key).select("s"), store.values(key).select("s")]
        else:
            each = value if isinstance(value, list) and not isinstance(value, Or) else [value]
            wanted += [_value_criterion(store, key, x, case_sensitive, use_str_as_loc) for x in each]
    if not wanted:
        wanted = [store.quads.select("s")]
    out = reduce(lambda a, b: a.join(b, "s", "left_semi"), wanted)
    if absent:
        out = out.join(reduce(lambda a, b: a.unionByName(b), absent), "s", "left_anti")
    return out.distinct()


def search_bm25(store: QuadStore, p: str, query: str, **criteria: object) -> DataFrame:
    """(s, bm25) of the subjects that also meet the criteria, to be ordered by bm25."""
    scored = fts.bm25(store.values(p), query)
    return scored.join(search(store, **criteria), "s", "left_semi") if criteria else scored


def either(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results).distinct()


def both(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), results)
