"""Class expressions as predicates over individuals, and the restrictions view.

An expression compiles to the DataFrame (s) of individuals that satisfy it on
the asserted data, all at once: semi-joins, anti-joins, unions, grouped counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.terms import Loc, literal_lex
from ..sources.store import QuadStore
from .closure import checkpointed, fingerprint, hierarchy, list_items, sift


class Expression:
    def __invert__(self):
        return self.of if isinstance(self, Not) else Not(self)

    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))


@dataclass(frozen=True)
class Named(Expression):
    iri: str


@dataclass(frozen=True)
class Not(Expression):
    of: Expression


@dataclass(frozen=True)
class And(Expression):
    of: tuple


@dataclass(frozen=True)
class Or(Expression):
    of: tuple


@dataclass(frozen=True)
class OneOf(Expression):
    """Individuals (IRIs) listed by name, or literals as Python values."""

    members: tuple


def is_iri(x: object) -> bool:
    return isinstance(x, str) and ("://" in x or x.startswith(("urn:", "_:")))


@dataclass(frozen=True)
class Property:
    """A property, read backwards where ``inverse`` is set, or a chain of properties."""

    iri: str = ""
    inverse: bool = False
    chain: tuple = ()

    def some(self, c):
        return Restriction(self, "some", c)

    def only(self, c):
        return Restriction(self, "only", c)

    def value(self, x):
        return Restriction(self, "value", x)

    def has_self(self):
        return Restriction(self, "self", None)

    def min(self, n, c=None):
        return Restriction(self, "min", c, n)

    def max(self, n, c=None):
        return Restriction(self, "max", c, n)

    def exactly(self, n, c=None):
        return Restriction(self, "exactly", c, n)

    def __invert__(self):
        return Property(self.iri, not self.inverse, tuple(~p for p in reversed(self.chain)))

    def __ge__(self, x):
        return self.some(Facets(min_inclusive=x))

    def __gt__(self, x):
        return self.some(Facets(min_exclusive=x))

    def __le__(self, x):
        return self.some(Facets(max_inclusive=x))

    def __lt__(self, x):
        return self.some(Facets(max_exclusive=x))


@dataclass(frozen=True)
class Restriction(Expression):
    prop: Property
    kind: str
    filler: object
    n: int = 0


@dataclass(frozen=True)
class Facets:
    """A datatype with constraining facets, as a predicate over literal rows."""

    base: str | None = None
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    total_digits: int | None = None
    fraction_digits: int | None = None
    white_space: str | None = None

    def column(self) -> Column:
        lex, num = F.col("lex"), F.col("num")
        digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
        tests = {
            "base": lambda x: F.col("d") == x,
            "length": lambda x: F.length(lex) == x,
            "min_length": lambda x: F.length(lex) >= x,
            "max_length": lambda x: F.length(lex) <= x,
            "pattern": lambda x: lex.rlike(f"^(?:{x})$"),
            "min_inclusive": lambda x: num >= x,
            "max_inclusive": lambda x: num <= x,
            "min_exclusive": lambda x: num > x,
            "max_exclusive": lambda x: num < x,
            "total_digits": lambda x: digits(lex) <= x,
            "fraction_digits": lambda x: F.length(F.regexp_extract(lex, r"\.(\d+)$", 1)) <= x,
            "white_space": lambda x: F.lit(True) if x == "preserve" else ~lex.rlike(r"[\t\n\r]" if x == "replace" else r"[\t\n\r]|^ | $|  "),
        }
        chosen = [tests[k](x) for k in tests if (x := getattr(self, k)) is not None]
        return reduce(lambda a, b: a & b, chosen, F.lit(True))


def edges(store: QuadStore, prop: Property) -> DataFrame:
    """(s, o) of a property, its inverse or a chain."""
    if prop.chain:
        steps = [edges(store, p) for p in prop.chain]
        return reduce(lambda a, b: a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o").distinct(), steps)
    pairs = store.pairs(prop.iri)
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o")) if prop.inverse else pairs


class Evaluator:
    """Expressions over one store; ``domain`` (s) are the individuals that complements are taken in."""

    def __init__(self, store: QuadStore, domain: DataFrame | None = None):
        self.store = store
        self.spark = store.objs.sparkSession
        self.domain = domain if domain is not None else store.scan("objs", p=v.TYPE).select("s").distinct()
        self.hierarchy = hierarchy(store, v.SUBCLASS)

    def satisfied_by(self, x: Expression) -> DataFrame:
        if isinstance(x, Named):
            if x.iri == v.THING:
                return self.domain
            few = self.hierarchy.names_below([x.iri])
            if few is not None:
                return self.store.scan("objs", p=v.TYPE, o=few).select("s").distinct()
            below = self.hierarchy.below(self.spark, [x.iri]).select(F.col("cls").alias("o"))
            return self.store.scan("objs", p=v.TYPE).join(below, "o", "left_semi").select("s").distinct()
        if isinstance(x, Not):
            return self.domain.join(self.satisfied_by(x.of), "s", "left_anti")
        if isinstance(x, And):
            return reduce(lambda a, b: a.join(b, "s", "left_semi"), map(self.satisfied_by, x.of))
        if isinstance(x, Or):
            return reduce(lambda a, b: a.unionByName(b), map(self.satisfied_by, x.of)).distinct()
        if isinstance(x, OneOf):
            return self.spark.createDataFrame([(m,) for m in dict.fromkeys(x.members)], "s string")
        return self._restriction(x)

    def _values(self, r: Restriction) -> DataFrame:
        """(s, o) of the restriction's property whose value is in its filler."""
        if isinstance(r.filler, Facets):
            return self.store.values(r.prop.iri).where(r.filler.column()).select("s", F.col("lex").alias("o"))
        if isinstance(r.filler, OneOf) and not all(map(is_iri, r.filler.members)):
            texts = [literal_lex(x)[0] for x in r.filler.members]
            return self.store.values(r.prop.iri).where(F.col("lex").isin(*texts)).select("s", F.col("lex").alias("o"))
        pairs = edges(self.store, r.prop)
        if r.filler is None or r.filler == Named(v.THING):
            return pairs
        return pairs.join(self.satisfied_by(r.filler).select(F.col("s").alias("o")), "o", "left_semi").select("s", "o")

    def _restriction(self, r: Restriction) -> DataFrame:
        if r.kind == "some":
            return self._values(r).select("s").distinct()
        if r.kind == "only":
            if isinstance(r.filler, Facets):
                bad = self.store.values(r.prop.iri).where(~F.coalesce(r.filler.column(), F.lit(False)))
            else:
                bad = edges(self.store, r.prop).join(self.satisfied_by(r.filler).select(F.col("s").alias("o")), "o", "left_anti")
            return self.domain.join(bad.select("s"), "s", "left_anti")
        if r.kind == "value":
            if isinstance(r.filler, str) and "://" in r.filler:
                return edges(self.store, r.prop).where(F.col("o") == r.filler).select("s").distinct()
            return self.store.values(r.prop.iri).where(F.col("lex") == literal_lex(r.filler)[0]).select("s").distinct()
        if r.kind == "self":
            return edges(self.store, r.prop).where("s = o").select("s").distinct()
        counted = self._values(r).groupBy("s").agg(F.count_distinct("o").alias("n"))
        if r.kind == "min" and r.n > 0:
            return counted.where(F.col("n") >= r.n).select("s")
        n = F.coalesce("n", F.lit(0))
        test = {"min": n >= r.n, "max": n <= r.n, "exactly": n == r.n}[r.kind]
        return self.domain.join(counted, "s", "left").where(test).select("s")


def restrictions(store: QuadStore) -> DataFrame:
    """(cls, source, property, inverse, kind, cardinality, filler, filler_lex) of restrictions on named classes.

    Members of an intersection hold for the class as the intersection does.
    Blank nodes are pivoted on the few construct predicates by one grouping.
    """
    links = store.scan("objs", p=[v.SUBCLASS, v.EQUIVALENT_CLASS]).where(F.col("o").startswith("_:")).select("s", "p", "o")
    if store.has("objs", p=v.INTERSECTION):
        inner = store.scan("objs", p=v.INTERSECTION).select(F.col("s").alias("o"), F.col("o").alias("lst"))
        parts = inner.join(lists(store), "lst").where(F.startswith("item", F.lit("_:"))).select("o", "item")
        links = links.unionByName(links.join(parts, "o").select("s", "p", F.col("item").alias("o")))
    picked = [v.ON_PROPERTY, v.SOME, v.ONLY, v.VALUE, v.ON_CLASS]
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    objs = store.scan("objs", p=picked).groupBy("s").agg(
        pick(v.ON_PROPERTY).alias("property"), pick(v.SOME).alias("some"), pick(v.ONLY).alias("only"), pick(v.VALUE).alias("value"), pick(v.ON_CLASS).alias("on_class")
    )
    kind = F.create_map(*(F.lit(x) for kv in v.CARDINALITIES.items() for x in kv))
    datas = store.scan("datas", p=[*v.CARDINALITIES, v.VALUE, v.HAS_SELF]).groupBy("s").agg(
        F.max(F.when(F.col("p").isin(*v.CARDINALITIES), F.element_at(kind, F.col("p")))).alias("counting"),
        F.max(F.when(F.col("p").isin(*v.CARDINALITIES), F.col("lex").try_cast("int"))).alias("cardinality"),
        F.max(F.when(F.col("p") == v.VALUE, F.col("lex"))).alias("filler_lex"),
        F.max(F.when(F.col("p") == v.HAS_SELF, F.lit("self"))).alias("self"),
    )
    back = store.scan("objs", p=v.INVERSE_OF).where(F.col("s").startswith("_:")).select(F.col("s").alias("property"), F.col("o").alias("of"))
    nodes = objs.where("property IS NOT NULL").join(datas, "s", "left").join(back, "property", "left")
    named = F.when(F.col("some").isNotNull(), "some").when(F.col("only").isNotNull(), "only").when(F.col("value").isNotNull() | F.col("filler_lex").isNotNull(), "value")
    view = nodes.select(
        F.col("s").alias("node"), F.coalesce("of", "property").alias("property"), F.col("of").isNotNull().alias("inverse"),
        F.coalesce(named, "self", "counting").alias("kind"), "cardinality", F.coalesce("some", "only", "value", "on_class").alias("filler"), "filler_lex",
    )
    source = F.when(F.col("p") == v.SUBCLASS, "is_a").otherwise("equivalent_to")
    return links.select(F.col("s").alias("cls"), source.alias("source"), F.col("o").alias("node")).join(view, "node").drop("node")


@dataclass
class Writer:
    """Encodes expressions as quads with blank nodes numbered from a prefix."""

    graph: str
    prefix: str
    objs: list = field(default_factory=list)
    datas: list = field(default_factory=list)
    count: int = 0

    def blank(self) -> str:
        self.count += 1
        return f"_:{self.prefix}{self.count}"

    def list_of(self, items: list[str]) -> str:
        if not items:
            return v.NIL
        nodes = [self.blank() for _ in items]
        for node, item, after in zip(nodes, items, [*nodes[1:], v.NIL], strict=True):
            self.objs += [(self.graph, node, v.FIRST, item), (self.graph, node, v.REST, after)]
        return nodes[0]

    def _data(self, s: str, p: str, value: object) -> None:
        lex, d, lang = literal_lex(value)
        self.datas.append((self.graph, s, p, lex, float(lex) if d in v.INTEGERS or d in v.DECIMALS else None, d, lang))

    def _literals(self, values: tuple) -> str:
        cells = [self.blank() for _ in values]
        for cell, value, after in zip(cells, values, [*cells[1:], v.NIL], strict=True):
            self._data(cell, v.FIRST, value)
            self.objs.append((self.graph, cell, v.REST, after))
        return cells[0]

    def _facets(self, x: Facets) -> str:
        node, cells = self.blank(), []
        self.objs += [(self.graph, node, v.TYPE, v.DATATYPE), (self.graph, node, v.ON_DATATYPE, x.base or v.STRING)]
        for name, p in v.FACETS.items():
            if getattr(x, name) is not None:
                cells.append(self.blank())
                self._data(cells[-1], p, getattr(x, name))
        self.objs.append((self.graph, node, v.WITH_RESTRICTIONS, self.list_of(cells)))
        return node

    def encode(self, x: object) -> str:
        if isinstance(x, str):
            return x
        if isinstance(x, Named):
            return x.iri
        if isinstance(x, Facets):
            return self._facets(x)
        node = self.blank()
        add = lambda p, o: self.objs.append((self.graph, node, p, o))
        if isinstance(x, Not):
            add(v.TYPE, v.CLASS)
            add(v.COMPLEMENT, self.encode(x.of))
        elif isinstance(x, (And, Or)):
            add(v.TYPE, v.CLASS)
            add(v.INTERSECTION if isinstance(x, And) else v.UNION, self.list_of([self.encode(y) for y in x.of]))
        elif isinstance(x, OneOf):
            add(v.TYPE, v.CLASS)
            add(v.ONE_OF, self.list_of(list(x.members)) if all(map(is_iri, x.members)) else self._literals(x.members))
        elif isinstance(x, Restriction):
            add(v.TYPE, v.RESTRICTION)
            on = x.prop.iri
            if x.prop.inverse:
                on = self.blank()
                self.objs.append((self.graph, on, v.INVERSE_OF, x.prop.iri))
            add(v.ON_PROPERTY, on)
            if x.kind in ("some", "only"):
                add(v.SOME if x.kind == "some" else v.ONLY, self.encode(x.filler))
            elif x.kind == "value" and isinstance(x.filler, str) and "://" in x.filler:
                add(v.VALUE, x.filler)
            elif x.kind in ("value", "self"):
                lex, d, lang = literal_lex(True if x.kind == "self" else x.filler)
                self.datas.append((self.graph, node, v.HAS_SELF if x.kind == "self" else v.VALUE, lex, float(lex) if d in v.INTEGERS or d in v.DECIMALS else None, d, lang))
            else:
                name = {"min": "min", "max": "max", "exactly": ""}[x.kind]
                kind = f"{name}{'Q' if name else 'q'}ualifiedCardinality" if x.filler is not None else f"{name}{'C' if name else 'c'}ardinality"
                self.datas.append((self.graph, node, v.OWL + kind, str(x.n), float(x.n), v.XSD + "nonNegativeInteger", None))
                if x.filler is not None:
                    add(v.ON_DATA_RANGE if isinstance(x.filler, Facets) else v.ON_CLASS, self.encode(x.filler))
        else:
            raise TypeError(f"cannot encode {x!r}")
        return node


def lists(store: QuadStore) -> DataFrame:
    """(lst, pos, item) of every list that is not itself the rest of another."""
    first, rest = store.scan("objs", p=v.FIRST).select("s", "o"), store.scan("objs", p=v.REST).select("s", "o")
    return list_items(first, rest).drop("length")


class Reader:
    """Stored constructs as expressions again: the inverse of ``Writer``.

    Axioms are metadata, so their rows are read to the driver once, and there may
    be ``most`` of them; a larger number is an error.
    """

    def __init__(self, store: QuadStore, most: int = 200_000):
        picked = [v.COMPLEMENT, v.UNION, v.INTERSECTION, v.ONE_OF, v.SOME, v.ONLY, v.VALUE, v.ON_CLASS, v.ON_DATA_RANGE, v.ON_PROPERTY, v.INVERSE_OF, v.FIRST, v.REST, v.ON_DATATYPE, v.WITH_RESTRICTIONS]
        objs = store.scan("objs", p=picked).where("startswith(s, '_:')").select("s", "p", "o").limit(most + 1).collect()
        datas = store.scan("datas", p=[v.FIRST, v.VALUE, v.HAS_SELF, *v.CARDINALITIES, *v.FACETS.values()]).where("startswith(s, '_:')").select("s", "p", "lex", "d", "lang").limit(most + 1).collect()
        if len(objs) > most or len(datas) > most:
            raise ValueError(f"more than {most} rows of constructs")
        self.objs: dict[str, dict[str, str]] = {}
        self.datas: dict[str, dict[str, object]] = {}
        for s, p, o in objs:
            self.objs.setdefault(s, {})[p] = o
        for s, p, lex, d, lang in datas:
            self.datas.setdefault(s, {})[p] = _value(lex, d, lang)
        self.store = store

    def items(self, cell: str) -> list:
        out, seen = [], set()
        while cell != v.NIL and cell not in seen:
            seen.add(cell)
            own = self.objs.get(cell, {})
            out.append(own[v.FIRST] if v.FIRST in own else self.datas[cell][v.FIRST])
            cell = own.get(v.REST, v.NIL)
        return out

    def prop(self, node: str) -> Property:
        back = self.objs.get(node, {}).get(v.INVERSE_OF) if node.startswith("_:") else None
        return Property(back, True) if back else Property(node)

    def read(self, node: str) -> Expression | Facets:
        """The expression of a node; an IRI is a named class."""
        if not node.startswith("_:"):
            return Named(node)
        own, values = self.objs.get(node, {}), self.datas.get(node, {})
        if v.COMPLEMENT in own:
            return Not(self.read(own[v.COMPLEMENT]))
        if v.INTERSECTION in own:
            return And(tuple(self.read(x) for x in self.items(own[v.INTERSECTION])))
        if v.UNION in own:
            return Or(tuple(self.read(x) for x in self.items(own[v.UNION])))
        if v.ONE_OF in own:
            return OneOf(tuple(self.items(own[v.ONE_OF])))
        if v.ON_DATATYPE in own:
            cells = [c for c in self._cells(own.get(v.WITH_RESTRICTIONS, v.NIL))]
            given = {name: self.datas[c][p] for c in cells for name, p in v.FACETS.items() if p in self.datas.get(c, {})}
            return Facets(base=own[v.ON_DATATYPE], **given)
        if v.ON_PROPERTY not in own:
            raise ValueError(f"{node} is no construct")
        p = self.prop(own[v.ON_PROPERTY])
        for kind, iri in (("some", v.SOME), ("only", v.ONLY)):
            if iri in own:
                return Restriction(p, kind, self.read(own[iri]))
        if v.VALUE in own or v.VALUE in values:
            return p.value(own.get(v.VALUE, values.get(v.VALUE)))
        if v.HAS_SELF in values:
            return p.has_self()
        counted = next(x for x in values if x in v.CARDINALITIES)
        filler = own.get(v.ON_CLASS) or own.get(v.ON_DATA_RANGE)
        return Restriction(p, v.CARDINALITIES[counted], self.read(filler) if filler else None, int(values[counted]))

    def _cells(self, cell: str) -> list[str]:
        return [x for x in self.items(cell) if isinstance(x, str)]

    def definitions(self) -> list[tuple[str, str, Expression]]:
        """(class, is_a or equivalent_to, expression) of the anonymous classes that named ones have."""
        rows = self.store.scan("objs", p=[v.SUBCLASS, v.EQUIVALENT_CLASS]).where("startswith(o, '_:') AND NOT startswith(s, '_:')").select("s", "p", "o").collect()
        return sorted(((s, "is_a" if p == v.SUBCLASS else "equivalent_to", self.read(o)) for s, p, o in rows), key=str)

    def subclasses(self, x: Expression) -> list[str]:
        """Named classes that are beneath, or equivalent to, a construct equal to ``x``."""
        return sorted({s for s, _, e in self.definitions() if e == x})


def _value(lex: str, d: str | None, lang: str | None) -> object:
    if d in v.INTEGERS:
        return int(lex)
    if d in v.DECIMALS:
        return float(lex)
    if d == v.BOOLEAN:
        return lex in ("true", "1")
    return Loc(lex, lang) if lang else lex


def list_cells(store: QuadStore) -> DataFrame:
    """(cell, lst, pos, length, owner): each list cell with its list, its place in it, and what refers to the list."""
    first, rest = store.scan("objs", p=v.FIRST).select("s", "o").unionByName(store.scan("datas", p=v.FIRST).select("s", F.col("lex").alias("o"))), store.scan("objs", p=v.REST).select("s", "o")
    # Where cells with an item and cells that go on are the same, none is looked for.
    whole = fingerprint(first.select("s")) == fingerprint(rest.select("s"))
    cells = list_items(None if whole else first.select("s", F.col("s").alias("o")), rest).withColumnRenamed("item", "cell")
    owner = store.objs.where(~F.col("p").isin(v.FIRST, v.REST)).select(F.col("o").alias("lst"), F.col("s").alias("owner"))
    owner = sift(owner, "lst", cells.where("pos = 1").select("lst"))[0].groupBy("lst").agg(F.min("owner").alias("owner"))
    return cells.join(owner, "lst", "left").select("cell", "lst", "pos", "length", "owner")
