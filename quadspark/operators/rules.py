"""Forward-chaining rules: bodies are joins on shared variables, heads are new triples.

    rule = Rule([Cls("Person", "?x"), Data("weight", "?x", "?w"), Builtin("divide", "?r", "?w", 2)], [Data("half", "?x", "?r")])

Atoms are reordered so that a built-in runs once its inputs are bound. A set of
rules is applied until no new triple appears; each round's result is cut from
its lineage with checkpoint().
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.builtins import BUILTINS, TESTS
from ..functions.terms import literal_lex
from ..sources.store import QuadStore
from .closure import checkpointed, reachable
from .constructs import Writer, _value, is_iri


@dataclass(frozen=True)
class Cls:
    iri: str
    x: str


@dataclass(frozen=True)
class Obj:
    p: str
    x: str
    y: str


@dataclass(frozen=True)
class Data:
    p: str
    x: str
    y: object


@dataclass(frozen=True)
class Same:
    x: str
    y: str


@dataclass(frozen=True)
class Different:
    x: str
    y: str


@dataclass(frozen=True)
class Range:
    """The literal in ``x`` has the datatype."""

    datatype: str
    x: str


@dataclass(frozen=True, init=False)
class Builtin:
    name: str
    args: tuple

    def __init__(self, name: str, *args: object):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "args", args)
        if name not in BUILTINS:
            raise ValueError(f"no built-in {name}")


@dataclass(frozen=True)
class Rule:
    body: list
    head: list

    def __str__(self) -> str:
        return f"{', '.join(map(show, self.body))} -> {', '.join(map(show, self.head))}"


def show(atom: object) -> str:
    text = lambda x: x if isinstance(x, str) and x.startswith("?") else f'"{x}"' if isinstance(x, str) and "://" not in x else str(x)
    if isinstance(atom, Cls):
        return f"{atom.iri}({text(atom.x)})"
    if isinstance(atom, Range):
        return f"{atom.datatype}({text(atom.x)})"
    if isinstance(atom, (Obj, Data)):
        return f"{atom.p}({text(atom.x)}, {text(atom.y)})"
    if isinstance(atom, Builtin):
        return f"{atom.name}({', '.join(map(text, atom.args))})"
    return f"{'SameAs' if isinstance(atom, Same) else 'DifferentFrom'}({text(atom.x)}, {text(atom.y)})"


def is_var(x: object) -> bool:
    return isinstance(x, str) and x.startswith("?")


def _term(x: object, have: set[str]) -> Column:
    return F.col(x[1:]) if is_var(x) and x[1:] in have else F.lit(x)


def _relation(store: QuadStore, atom: object) -> DataFrame:
    """An atom's rows, with a column for each variable."""
    if isinstance(atom, Cls):
        rows = store.scan("objs", p=v.TYPE, o=atom.iri).select("s")
        args = [("s", atom.x)]
    elif isinstance(atom, Obj):
        rows, args = store.pairs(atom.p), [("s", atom.x), ("o", atom.y)]
    elif isinstance(atom, (Same, Different)):
        p = v.SAME_AS if isinstance(atom, Same) else v.DIFFERENT_FROM
        one = store.scan("objs", p=p).select("s", "o")
        rows, args = one.unionByName(one.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct(), [("s", atom.x), ("o", atom.y)]
    else:
        numeric = F.col("num").isNotNull()
        rows = store.values(atom.p)
        if not is_var(atom.y):
            lex = literal_lex(atom.y)[0]
            rows = rows.where(F.col("num") == atom.y if isinstance(atom.y, (int, float)) and not isinstance(atom.y, bool) else F.col("lex") == lex).select("s")
            args = [("s", atom.x)]
        else:
            name = atom.y[1:]
            rows = rows.select("s", F.col("lex").alias("o"), F.when(numeric, F.col("num")).alias(f"{name}#num"), F.col("d").alias(f"{name}#d"))
            args = [("s", atom.x), ("o", atom.y)]
    for column, x in args:
        if not is_var(x):
            rows = rows.where(F.col(column) == x).drop(column)
    named = [(c, x[1:]) for c, x in args if is_var(x)]
    if len(named) == 2 and named[0][1] == named[1][1]:
        rows, named = rows.where("s = o").drop("o"), named[:1]
    kept = [c for c in rows.columns if "#" in c]
    return rows.select(*(F.col(column).alias(name) for column, name in named), *(F.col(f"`{c}`") for c in kept))


def _argument(x: object, rows: DataFrame, numeric: bool) -> Column:
    if not is_var(x):
        return F.lit(x)
    name = x[1:]
    return F.col(f"`{name}#num`") if numeric and f"{name}#num" in rows.columns else F.col(f"`{name}`")


_TEXT = {"contains", "startsWith", "endsWith", "matches", "containsIgnoreCase", "stringEqualIgnoreCase", "stringConcat", "substring", "stringLength", "upperCase", "lowerCase", "normalizeSpace", "translate", "replace", "tokenize", "substringBefore", "substringAfter", "resolveURI", "anyURI"}


def _apply(rows: DataFrame, atom: Builtin) -> DataFrame:
    test = atom.name in TESTS
    inputs = atom.args if test else atom.args[1:]
    value = BUILTINS[atom.name](*(_argument(x, rows, atom.name not in _TEXT) for x in inputs))
    if test:
        return rows.where(value)
    out = atom.args[0]
    if not is_var(out) or out[1:] in rows.columns:
        return rows.where(_argument(out, rows, atom.name not in _TEXT) == value)
    made = rows.withColumn(out[1:], value)
    return made.withColumn(f"{out[1:]}#num", F.col(f"`{out[1:]}`").cast("double")) if atom.name not in _TEXT and dict(made.dtypes)[out[1:]] in ("double", "bigint", "int") else made


def bindings(store: QuadStore, body: list) -> DataFrame:
    """A row for each way to satisfy the body."""
    waiting, out = list(body), None
    while waiting:
        bound = set() if out is None else set(out.columns)

        def ready(a: object, bound: set[str] = bound) -> bool:
            if isinstance(a, Range):
                return a.x[1:] in bound
            if isinstance(a, Builtin):
                needs = a.args if a.name in TESTS else a.args[1:]
                return all(not is_var(x) or x[1:] in bound for x in needs)
            return False

        atom = next((a for a in waiting if ready(a)), None)
        if atom is None:  # the relation that shares most variables comes next, so that joins are on keys
            relations = [a for a in waiting if not isinstance(a, (Builtin, Range))]
            if not relations:
                raise ValueError("a built-in's inputs are never bound")
            variables = lambda a: {x[1:] for x in vars(a).values() if is_var(x)}
            atom = max(relations, key=lambda a: len(variables(a) & bound))
        waiting.remove(atom)
        if isinstance(atom, Builtin):
            out = _apply(out, atom)
        elif isinstance(atom, Range):
            out = out.where(F.col(f"`{atom.x[1:]}#d`") == atom.datatype)
        else:
            rows = _relation(store, atom)
            if out is None:
                out = rows
            else:
                shared = [c for c in rows.columns if c in out.columns and "#" not in c]
                if not shared:
                    raise ValueError(f"no variable links {show(atom)} with the atoms before it")
                out = out.join(rows.drop(*(c for c in rows.columns if "#" in c and c in out.columns)), shared)
    return out


def consequences(store: QuadStore, rule: Rule, graph: str = "inferred") -> tuple[DataFrame | None, DataFrame | None]:
    """The head's triples (objs, datas) for all bindings of the body."""
    rows = bindings(store, rule.body)
    have = set(rows.columns)
    objs, datas = [], []
    for a in rule.head:
        if isinstance(a, Data):
            name = a.y[1:] if is_var(a.y) else None
            lex, d, _ = literal_lex(a.y) if name is None else (None, None, None)
            kind = dict(rows.dtypes).get(name, "string")
            num = F.lit(float(a.y) if isinstance(a.y, (int, float)) else None).cast("double") if name is None else F.col(f"`{name}#num`") if f"{name}#num" in have else F.lit(None).cast("double")
            datatype = F.lit(d) if name is None else F.col(f"`{name}#d`") if f"{name}#d" in have else F.lit(v.DOUBLE if kind == "double" else v.INTEGER if kind in ("bigint", "int") else v.STRING)
            text = F.lit(lex) if name is None else F.col(f"`{name}`").cast("string")
            datas.append(rows.select(F.lit(graph).alias("c"), _term(a.x, have).alias("s"), F.lit(a.p).alias("p"), text.alias("lex"), num.alias("num"), datatype.alias("d"), F.lit(None).cast("string").alias("lang")))
        else:
            p = {Cls: v.TYPE, Same: v.SAME_AS, Different: v.DIFFERENT_FROM}.get(type(a)) or a.p
            o = F.lit(a.iri) if isinstance(a, Cls) else _term(a.y, have)
            objs.append(rows.select(F.lit(graph).alias("c"), _term(a.x, have).alias("s"), F.lit(p).alias("p"), o.alias("o")))
    union = lambda x: reduce(lambda m, n: m.unionByName(n), x).distinct() if x else None
    return union(objs), union(datas)


def run(store: QuadStore, rules: list[Rule], graph: str = "inferred", most_rounds: int = 100) -> QuadStore:
    """The store with everything that the rules give, in graph ``graph``."""
    for _ in range(most_rounds):
        grew = False
        for kind, keys in (("objs", ["s", "p", "o"]), ("datas", ["s", "p", "lex"])):
            parts = [x for r in rules if (x := consequences(store, r, graph)[kind == "datas"]) is not None]
            if not parts:
                continue
            new = reduce(lambda a, b: a.unionByName(b), parts).distinct().join(getattr(store, kind).select(*keys), keys, "left_anti")
            new = checkpointed(new.dropDuplicates(keys))
            if not new.isEmpty():
                grew = True
                store = store.plus(kind, new)
        if not grew:
            return store
    raise RuntimeError("the rules did not come to an end")


# ---- text and storage -----------------------------------------------------------------
_ATOM = re.compile(r"""([^\s(),]+)\s*\(([^()]*)\)""")
_ARGUMENT = re.compile(r"""\s*("(?:[^"\\\\]|\\\\.)*"|'[^']*'|[^,\s]+)\s*(?:,|$)""")


def _argument_of(text: str, names: dict[str, str]) -> object:
    if text[0] in "\"'":
        return text[1:-1]
    if text.startswith("?"):
        return text
    if text in ("true", "false"):
        return text == "true"
    try:
        return float(text) if any(c in text for c in ".eE") and "/" not in text else int(text)
    except ValueError:
        return names.get(text, text)


def from_text(text: str, names: dict[str, str], kinds: dict[str, str]) -> Rule:
    """A rule as it is printed: ``A(?x), p(?x, ?y) -> B(?x)``.

    ``names`` gives the IRIs of short names, ``kinds`` says of an IRI whether it
    is a ``class``, an ``object`` or a ``data`` property, or a ``datatype``.
    """

    def atoms(side: str) -> list:
        out = []
        for name, inner in _ATOM.findall(side):
            args = [_argument_of(m, names) for m in _ARGUMENT.findall(inner)]
            iri = names.get(name, name)
            kind = kinds.get(iri)
            if name in ("SameAs", "DifferentFrom"):
                out.append((Same if name == "SameAs" else Different)(*args))
            elif kind in ("class", "datatype"):
                out.append((Cls if kind == "class" else Range)(iri, *args))
            elif kind in ("object", "data"):
                out.append((Obj if kind == "object" else Data)(iri, *args))
            elif name in BUILTINS:
                out.append(Builtin(name, *args))
            else:
                raise ValueError(f"unknown name {name}")
        return out

    body, arrow, head = text.partition("->")
    if not arrow:
        raise ValueError("a rule needs ->")
    return Rule(atoms(body), atoms(head))


# The classes of atoms and what they name.
_STORED = {Cls: ("ClassAtom", "classPredicate"), Obj: ("IndividualPropertyAtom", "propertyPredicate"), Data: ("DatavaluedPropertyAtom", "propertyPredicate"), Same: ("SameIndividualAtom", None), Different: ("DifferentIndividualsAtom", None), Range: ("DataRangeAtom", "dataRange"), Builtin: ("BuiltinAtom", "builtin")}
_VARIABLES = "urn:swrl#"
_BUILTIN_NS = "http://www.w3.org/2003/11/swrlb#"


def encode(rule: Rule, graph: str, prefix: str) -> Writer:
    """The rule as quads (a ``Writer``'s objs and datas): an Imp with two lists of atoms; variables are ``urn:swrl#name``."""
    w = Writer(graph, prefix)
    add = lambda s, p, o: w.objs.append((graph, s, p, o))

    def argument(node: str, p: str, x: object) -> None:
        if is_var(x):
            add(_VARIABLES + x[1:], v.TYPE, v.VARIABLE)
            add(node, p, _VARIABLES + x[1:])
        elif is_iri(x):
            add(node, p, x)
        else:
            w._data(node, p, x)

    def atom(a: object) -> str:
        node = w.blank()
        kind, names = _STORED[type(a)]
        add(node, v.TYPE, v.SWRL + kind)
        if isinstance(a, Builtin):
            add(node, v.SWRL + names, _BUILTIN_NS + a.name)
            cells = [w.blank() for _ in a.args]
            add(node, v.SWRL + "arguments", cells[0] if cells else v.NIL)
            for cell, x, after in zip(cells, a.args, [*cells[1:], v.NIL], strict=True):
                argument(cell, v.FIRST, x)
                add(cell, v.REST, after)
            return node
        if names:
            add(node, v.SWRL + names, a.iri if isinstance(a, Cls) else a.datatype if isinstance(a, Range) else a.p)
        argument(node, v.SWRL + "argument1", a.x)
        if hasattr(a, "y"):
            argument(node, v.SWRL + "argument2", a.y)
        return node

    node = w.blank()
    add(node, v.TYPE, v.IMP)
    for p, side in ((v.BODY, rule.body), (v.HEAD, rule.head)):
        add(node, p, w.list_of([atom(a) for a in side]))
    w.objs = list(dict.fromkeys(w.objs))
    return w


def variables(store: QuadStore) -> DataFrame:
    """(s): the variables that stored rules use."""
    return store.scan("objs", p=v.TYPE, o=v.VARIABLE).select("s").distinct()


def stored_rules(store: QuadStore, most: int = 200_000) -> dict[str, Rule]:
    """Rules by their nodes, from the quads of all graphs; rules are metadata, of at most ``most`` rows."""
    about = store.scan("objs", p=[v.BODY, v.HEAD, v.FIRST, v.REST, *(v.SWRL + x for x in ("classPredicate", "propertyPredicate", "dataRange", "builtin", "arguments", "argument1", "argument2"))])
    rows = about.unionByName(store.scan("objs", p=v.TYPE).where(F.startswith("o", F.lit(v.SWRL)))).select("s", "p", "o").limit(most + 1).collect()
    texts = store.scan("datas", p=[v.FIRST, v.SWRL + "argument1", v.SWRL + "argument2"]).select("s", "p", "lex", "d", "lang").limit(most + 1).collect()
    if max(len(rows), len(texts)) > most:
        raise ValueError(f"more than {most} rows of rules")
    own: dict[str, dict[str, object]] = {}
    for s, p, o in rows:
        own.setdefault(s, {})[p] = "?" + o.removeprefix(_VARIABLES) if o.startswith(_VARIABLES) else o
    for s, p, lex, d, lang in texts:
        own.setdefault(s, {})[p] = _value(lex, d, lang)

    def items(cell: object) -> list:
        out = []
        while cell != v.NIL:
            out.append(own[cell][v.FIRST])
            cell = own[cell][v.REST]
        return out

    def atom(node: str) -> object:
        a = own[node]
        kind = next(k for k, (name, _) in _STORED.items() if a[v.TYPE] == v.SWRL + name)
        if kind is Builtin:
            return Builtin(a[v.SWRL + "builtin"].removeprefix(_BUILTIN_NS), *items(a[v.SWRL + "arguments"]))
        args = [a[p] for p in (v.SWRL + "argument1", v.SWRL + "argument2") if p in a]
        named = _STORED[kind][1]
        return kind(a[v.SWRL + named], *args) if named else kind(*args)

    return {s: Rule([atom(x) for x in items(a[v.BODY])], [atom(x) for x in items(a[v.HEAD])]) for s, a in own.items() if a.get(v.TYPE) == v.IMP}


def destroy_rule(store: QuadStore, node: str) -> QuadStore:
    """The store without a rule's node, lists and atoms, and without variables that no other rule uses."""
    links = store.scan("objs", p=[v.BODY, v.HEAD, v.FIRST, v.REST, v.SWRL + "arguments"]).where("startswith(o, '_:')").select(F.col("o").alias("s"), F.col("s").alias("o"))
    gone = checkpointed(reachable(links, store.objs.sparkSession.createDataFrame([(node,)], "s string"), True).select("s"))
    objs, datas = (f.join(gone, "s", "left_anti").select(*f.columns) for f in (store.objs, store.datas))
    used = objs.where(F.col("p") != v.TYPE).select(F.col("o").alias("s"))
    idle = objs.where((F.col("p") == v.TYPE) & (F.col("o") == v.VARIABLE)).select("s").join(used, "s", "left_anti")
    return replace(store, objs=objs.join(idle, "s", "left_anti").select(*objs.columns), datas=datas)
