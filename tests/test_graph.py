"""Search, constructs, values, rules, reasoning and changes on small graphs made in code."""

import pytest
from pyspark.sql import functions as F

from quadspark.functions import vocab as v
from quadspark.operators import closing, closure, constructs, diff, mutate, reason, render, rules, schema, terminology, values
from quadspark.operators.bgp import Pattern, update
from quadspark.operators.constructs import Evaluator, Facets, Named, Property, Writer
from quadspark.operators.search import FTS, Iri, NumS, Or, both, either, search, search_bm25
from quadspark.plans.views import QUERIES
from quadspark.sources.store import QuadStore

E = "http://ex/"
PIZZA = {
    "subs": "Cheese Topping, Meat Topping, Vegetable Topping, Eggplant Vegetable, Olive Vegetable, Tomato Vegetable, VegetarianPizza Pizza",
    "types": "ma_pizza Pizza, ma_tomate Tomato, mon_frometon Cheese",
}


def e(x):
    return E + x


def names(frame, column="s"):
    return {r[0].removeprefix(E) for r in frame.select(column).collect()}


def obj(s, p, o):
    return ("g", s if "://" in s or s[:2] == "_:" else e(s), p if "://" in p else e(p), o if "://" in o or o[:2] == "_:" else e(o))


def data(s, p, x, lang=None):
    from quadspark.functions.terms import Loc, literal_lex

    lex, d, lang = literal_lex(Loc(x, lang) if lang else x)
    return ("g", e(s), p if "://" in p else e(p), lex, float(lex) if isinstance(x, (int, float)) and not isinstance(x, bool) else None, d, lang)


@pytest.fixture(scope="module")
def pizza(spark):
    objs = [obj(a, v.SUBCLASS, b) for a, b in (x.split() for x in PIZZA["subs"].split(", "))]
    objs += [obj(a, v.TYPE, b) for a, b in (x.split() for x in PIZZA["types"].split(", "))]
    objs += [obj(a, v.TYPE, v.INDIVIDUAL) for a in ("ma_pizza", "ma_tomate", "mon_frometon")]
    objs += [obj(a, v.TYPE, v.CLASS) for a in "Pizza Topping Cheese Meat Vegetable Eggplant Olive Tomato VegetarianPizza".split()]
    objs += [obj("ma_pizza", "has_topping", x) for x in ("ma_tomate", "mon_frometon")]
    objs += [obj("topping_of", v.INVERSE_OF, "has_topping")]
    w = Writer("g", "c")
    objs += [("g", e("NonPizza"), v.SUBCLASS, w.encode(~Named(e("Pizza"))))]
    objs += [("g", e("VegetarianPizza"), v.SUBCLASS, w.encode(~Property(e("has_topping")).some(Named(e("Meat")))))]
    objs += w.objs
    datas = [data("ma_pizza", "price", 9.9), data("ma_pizza", v.COMMENT, "Une belle pizza", "fr"), data("ma_pizza", v.COMMENT, "A nice pizza", "en")]
    store = QuadStore.of_rows(spark, objs, datas)
    return QuadStore(store.objs, store.datas, store.declared_inverses())


def test_search(pizza):
    assert names(search(pizza, is_a=e("Pizza"))) == {"Pizza", "VegetarianPizza", "ma_pizza"}
    assert names(search(pizza, type=e("Topping"))) == {"ma_tomate", "mon_frometon"}
    assert names(search(pizza, {e("topping_of"): Iri(e("ma_pizza"))})) == {"ma_tomate", "mon_frometon"}
    assert names(search(pizza, subclass_of=e("Topping"))) >= {"Cheese", "Meat", "Vegetable", "Olive"}
    assert names(search(pizza, type=Or([e("Tomato"), e("Cheese")]))) == {"ma_tomate", "mon_frometon"}
    assert names(search(pizza, iri="*pizza", type=e("Pizza"))) == {"ma_pizza"}
    assert names(search(pizza, iri="*PIZZA", case_sensitive=False, type=e("Pizza"))) == {"ma_pizza"}
    assert names(search(pizza, {e("price"): NumS(">", 5, "<", 10)})) == {"ma_pizza"}
    assert names(search(pizza, {e("price"): 9.9})) == {"ma_pizza"}
    assert names(search(pizza, {e("has_topping"): [Iri(e("ma_tomate")), Iri(e("mon_frometon"))]})) == {"ma_pizza"}
    assert names(search(pizza, {e("price"): None}, type=v.INDIVIDUAL)) == {"ma_tomate", "mon_frometon"}
    nested = search(pizza, type=e("Vegetable"))
    assert names(search(pizza, {e("has_topping"): nested})) == {"ma_pizza"}
    assert names(search(pizza, {v.COMMENT: FTS("pizza belle")})) == {"ma_pizza"}
    assert names(search(pizza, {v.COMMENT: FTS("belle", "en")})) == set()
    assert names(search(pizza, {v.COMMENT: "A nice*"})) == {"ma_pizza"}
    assert names(either(nested, search(pizza, type=e("Cheese")))) == {"ma_tomate", "mon_frometon"}
    assert names(both(search(pizza, type=e("Topping")), nested)) == {"ma_tomate"}
    assert search_bm25(pizza, v.COMMENT, "nice").count() == 1


def test_cyclic_hierarchy_ends(spark):
    s = QuadStore.of_rows(spark, [obj("A", v.SUBCLASS, "B"), obj("B", v.SUBCLASS, "A"), obj("x", v.TYPE, "A")])
    assert names(search(s, type=e("B"))) == {"x"}


def test_catalogue(pizza):
    assert "Pizza" in names(schema.classes(pizza))
    assert names(schema.individuals(pizza)) == {"ma_pizza", "ma_tomate", "mon_frometon"}
    assert names(schema.children(pizza, e("Vegetable"))) == {"Eggplant", "Olive", "Tomato"}
    assert names(schema.constructs_of(pizza, e("Meat"))) == {"VegetarianPizza"}
    kinds = {r["s"].removeprefix(E): r["kind"] for r in schema.entity_kinds(pizza).collect()}
    assert kinds["Pizza"] == "class" and kinds["ma_pizza"] == "individual"


def test_constructs(pizza):
    ev = Evaluator(pizza, schema.individuals(pizza))
    top, tomato = Property(e("has_topping")), Named(e("Tomato"))
    assert names(ev.satisfied_by(top.some(tomato))) == {"ma_pizza"}
    assert names(ev.satisfied_by(top.only(tomato))) == {"ma_tomate", "mon_frometon"}
    assert names(ev.satisfied_by(~Named(e("Pizza")))) == {"ma_tomate", "mon_frometon"}
    assert names(ev.satisfied_by(top.min(2))) == {"ma_pizza"}
    assert names(ev.satisfied_by(top.exactly(0))) == {"ma_tomate", "mon_frometon"}
    assert names(ev.satisfied_by(top.max(1, tomato))) == {"ma_pizza", "ma_tomate", "mon_frometon"}
    assert names(ev.satisfied_by((~top).some(Named(e("Pizza"))))) == {"ma_tomate", "mon_frometon"}
    assert names(ev.satisfied_by(Property(e("price")) >= 9)) == {"ma_pizza"}
    assert names(ev.satisfied_by(Property(e("price")).some(Facets(fraction_digits=1)))) == {"ma_pizza"}


def test_restrictions_view(spark):
    w = Writer("g", "r")
    p = Property(e("p"))
    links = [("g", e("C"), v.SUBCLASS, w.encode(p.some(Named(e("D"))))), ("g", e("C"), v.EQUIVALENT_CLASS, w.encode(p.max(2, Named(e("F"))))), ("g", e("C"), v.SUBCLASS, w.encode(p.value(5)))]
    links.append(("g", e("C"), v.SUBCLASS, w.encode((~p).only(Named(e("G"))))))
    got = {(r.source, r.inverse, r.kind, r.cardinality, r.filler and r.filler.removeprefix(E), r.filler_lex) for r in constructs.restrictions(QuadStore.of_rows(spark, links + w.objs, w.datas)).collect()}
    assert got == {("is_a", False, "some", None, "D", None), ("equivalent_to", False, "max", 2, "F", None), ("is_a", False, "value", None, None, "5"), ("is_a", True, "only", None, "G", None)}


def test_lists_round_trip(spark):
    items = spark.createDataFrame([(f"_:l{k}", i + 1, f"{k}-{i}") for k in range(3) for i in range(k * 3 + 1)], "lst string, pos int, item string")
    found = constructs.lists(QuadStore(mutate.list_rows(items, "g"), QuadStore.empty(spark).datas))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, items.collect()))


def test_indirect_values(spark):
    s = QuadStore.of_rows(spark, [obj("p", v.TYPE, v.TRANSITIVE), obj("q", v.SUBPROPERTY, "p"), obj("a", "p", "b"), obj("b", "q", "c"), obj("c", v.SAME_AS, "d"), obj("d", "p", "x")])
    got = {(r.s.removeprefix(E), r.o.removeprefix(E)) for r in values.indirect(s, e("p"), members=True).collect()}
    assert {(r.s[-1], r.o[-1]) for r in values.indirect(s, e("p")).collect()} == {x for x in got if "d" not in x}
    assert got >= {("a", "b"), ("a", "c"), ("a", "d"), ("a", "x"), ("b", "x"), ("c", "x")} and ("x", "a") not in got


def test_literals_through_same_individuals_but_not_annotations(spark):
    s = QuadStore.of_rows(spark, [obj("c", v.SAME_AS, "f")], [data("c", "p", "1"), data("c", v.LABEL, "c")])
    assert {(r.s[-1], r.lex) for r in values.indirect_literals(s, e("p")).collect()} == {("c", "1"), ("f", "1")}
    assert {(r.s[-1], r.lex) for r in values.indirect_literals(s, v.LABEL, annotation=True).collect()} == {("c", "c")}


def test_annotations(spark):
    rows = spark.createDataFrame([(e("a"), e("p"), e("b"), "note", None, v.STRING)], "s string, p string, o string, lex string, num double, d string")
    objs, datas = values.annotate(rows, v.COMMENT, "g")
    found = values.annotations(QuadStore(objs, datas), v.COMMENT).collect()
    assert [(r.s, r.p, r.o, r.lex) for r in found] == [(e("a"), e("p"), e("b"), "note")]


def test_rule_with_builtins_in_any_order(spark):
    s = QuadStore.of_rows(spark, [obj("bob", v.TYPE, "Person")], [data("bob", "weight", 100), data("bob", "height", 2.0)])
    body = [rules.Cls(e("Person"), "?x"), rules.Builtin("divide", "?b", "?w", "?h2"), rules.Data(e("weight"), "?x", "?w"), rules.Builtin("multiply", "?h2", "?h", "?h"), rules.Data(e("height"), "?x", "?h")]
    rule = rules.Rule(body, [rules.Data(e("bmi"), "?x", "?b")])
    out = rules.run(s, [rule])
    assert [r.num for r in out.values(e("bmi")).collect()] == [25.0]
    assert str(rule).count("->") == 1


def test_rules_reach_a_fixpoint(spark):
    s = QuadStore.of_rows(spark, [obj(f"n{i}", "next", f"n{i + 1}") for i in range(5)])
    r = [rules.Rule([rules.Obj(e("next"), "?a", "?b")], [rules.Obj(e("far"), "?a", "?b")]), rules.Rule([rules.Obj(e("far"), "?a", "?b"), rules.Obj(e("next"), "?b", "?c")], [rules.Obj(e("far"), "?a", "?c")])]
    assert rules.run(s, r).scan("objs", p=e("far")).count() == 15


def test_inference(spark):
    w = Writer("g", "i")
    objs = [
        obj("D", v.SUBCLASS, "C"), obj("x", v.TYPE, "D"), obj("p", v.DOMAIN, "Dom"), obj("x", "p", "y"), obj("p", v.INVERSE_OF, "ip"),
        obj("pizza1", v.SAME_AS, "pizza2"), obj("pizza1", "has_topping", "t"), obj("t", v.TYPE, "Top"),
        ("g", e("Topped"), v.EQUIVALENT_CLASS, w.encode(Property(e("has_topping")).some(Named(e("Top"))))),
    ]
    out = reason.infer(QuadStore.of_rows(spark, objs + w.objs, w.datas))
    got = {(r.s.removeprefix(E), r.p.removeprefix(E), r.o.removeprefix(E)) for r in reason.for_members(out).collect()}
    assert not out.scan("objs", s=e("pizza2"), p=e("has_topping")).count()  # the class has one row
    assert {("x", v.TYPE, "C"), ("x", v.TYPE, "Dom"), ("y", "ip", "x"), ("pizza2", "has_topping", "t"), ("pizza1", v.TYPE, "Topped"), ("pizza2", v.TYPE, "Topped")} <= got


def test_violations(spark):
    s = QuadStore.of_rows(spark, [obj("A", v.DISJOINT_WITH, "B"), obj("x", v.TYPE, "A"), obj("x", v.TYPE, "B"), obj("p", v.TYPE, v.IRREFLEXIVE), obj("y", "p", "y")])
    assert {(r.s.removeprefix(E), r.kind) for r in reason.violations(s).collect()} == {("x", "disjoint"), ("y", "irreflexive")}


def test_close_world(spark):
    w = Writer("g", "w")
    objs = [obj("a", v.TYPE, "C"), obj("b", v.TYPE, "K"), obj("a", "p", "p1"), obj("a", "p", "p2"), ("g", e("K"), v.SUBCLASS, w.encode(Property(e("p")).some(Named(e("P")))))]
    people = spark.createDataFrame([(e("a"),), (e("b"),)], "s string")
    got = {r.s[-1]: (r.members, r.classes) for r in closing.close_individuals(QuadStore.of_rows(spark, objs + w.objs), [e("p")], people).collect()}
    assert got == {"a": ([e("p1"), e("p2")], []), "b": ([], [e("P")])}


def test_destroy_and_undo(pizza, spark):
    before = {tuple(r) for r in pizza.objs.collect()}
    left, lost = mutate.destroy(pizza, spark.createDataFrame([(e("Meat"),)], "s string"))
    kept = {tuple(r) for r in left.objs.collect()}
    assert not any(e("Meat") in r for r in kept) and kept < before
    assert ("g", e("VegetarianPizza"), v.SUBCLASS, e("Pizza")) in kept
    assert {tuple(r) for r in lost.undo(left).objs.collect()} == before


def test_set_and_refactor(pizza, spark):
    new = spark.createDataFrame([("g", e("ma_pizza"), e("has_topping"), e("ma_tomate"))], "c string, s string, p string, o string")
    assert names(mutate.set_values(pizza, new).pairs(e("has_topping")), "o") == {"ma_tomate"}
    renamed = mutate.refactor(pizza, {e("ma_pizza"): e("my_pizza")})
    assert names(search(renamed, type=e("Pizza"))) == {"my_pizza"}
    with pytest.raises(ValueError, match="null"):
        mutate.add(pizza, new.withColumn("o", F.lit(None).cast("string")))


def test_graph_patterns(pizza):
    p = Pattern(pizza).triple("?p", e("has_topping"), "?t").triple("?t", v.TYPE, "?c").optional(Pattern(pizza).data("?p", e("price"), "?x"))
    assert {(r.t.removeprefix(E), r.x) for r in p.filter(F.col("c") != v.INDIVIDUAL).select("t", "x").collect()} == {("ma_tomate", "9.9"), ("mon_frometon", "9.9")}
    moved = update(pizza, Pattern(pizza).triple("?p", e("has_topping"), "?t").rows, delete=[("?p", e("has_topping"), "?t")], insert=[("?p", e("has"), "?t")], graph="g")
    assert moved.scan("objs", p=e("has")).count() == 2 and not moved.has("objs", p=e("has_topping"))
    assert Pattern(pizza).path("?c", v.SUBCLASS, e("Topping")).rows.count() == 6


def test_diff_ignores_names_of_blank_nodes(spark):
    def graph(prefix, cls):
        w = Writer("g", prefix)
        return QuadStore.of_rows(spark, [("g", e("C"), v.SUBCLASS, w.encode(Property(e("p")).some(Named(e(cls)))))] + w.objs, w.datas)

    assert diff.diff(graph("a", "D"), graph("zz", "D")).count() == 0
    assert diff.diff(graph("a", "D"), graph("b", "F")).count() > 0


def test_diff_of_long_lists_with_swapped_tails(spark):
    def graph(prefix, *lists):
        rows = []
        for k, items in enumerate(lists):
            cell = lambda i: f"_:{prefix}{k}_{i}" if i < len(items) else v.NIL  # noqa: B023, E731
            rows += [t for i, x in enumerate(items) for t in (("g", cell(i), v.FIRST, e(x)), ("g", cell(i), v.REST, cell(i + 1)))]
        return QuadStore.of_rows(spark, rows, [])

    one, two, same = [*"ab", *"x" * 9, *"cd"], [*"ef", *"x" * 9, *"gh"], graph("p", [*"ab", *"x" * 9, *"cd"], [*"ef", *"x" * 9, *"gh"])
    assert diff.diff(same, graph("q", two, one)).count() == 0
    assert diff.diff(same, graph("r", one[:-2] + two[-2:], two[:-2] + one[-2:])).count() > 0


def test_diff_of_symmetric_blank_nodes(spark):
    def graph(prefix, edges):
        both = edges + [(b, a) for a, b in edges]
        return QuadStore.of_rows(spark, [("g", f"_:{prefix}{a}", e("p"), f"_:{prefix}{b}") for a, b in both], [])

    ring = lambda *x: list(zip(x, [*x[1:], x[0]], strict=True))
    triangles, hexagon = ring(0, 1, 2) + ring(3, 4, 5), ring(0, 1, 2, 3, 4, 5)
    assert diff.diff(graph("a", triangles), graph("b", hexagon)).count() == 24
    # Equal parts with other names, and twigs on a ring that need no marks.
    parts = lambda f: [(f"{k}x{f(a)}", f"{k}x{f(b)}") for k, edges in enumerate((triangles, hexagon)) for a, b in edges]
    twigs = [("0x0", f"t{i}") for i in range(9)]
    assert diff.diff(graph("a", parts(lambda x: x) + twigs), graph("b", parts(lambda x: (x + 3) % 6) + [("0x3", t) for _, t in twigs])).isEmpty()


def test_terminology(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "s string, o string")
    codes = lambda *x: spark.createDataFrame([(y,) for y in x], "s string")
    got = lambda f: {r[0] for r in f.collect()}
    below = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("d", "a"), ("e", "a")], "s string, o string")
    assert got(terminology.keep_most_specific(below, codes("a", "b", "d"))) == {"d"}
    assert got(terminology.keep_most_generic(below, codes("b", "d", "c"))) == {"b", "c"}
    assert got(terminology.lowest_common_ancestors(edges, ["d", "e"], "string")) == {"b"}
    assert got(terminology.remove_entire_families(edges, codes("d", "e", "c"))) == {"a"}
    assert got(terminology.subtract(below, codes("c", "d"), codes("b"))) == {"c"}
    mapping = spark.createDataFrame([("a", "X"), ("b", "Y")], "src string, dst string")
    assert {tuple(r) for r in terminology.map_concepts(codes("d", "c"), edges, mapping).collect()} == {("d", "Y"), ("c", "X")}
    votes = spark.createDataFrame([("x", "y", 5), ("x", "z", 1), ("y", "x", 1), ("z", "x", 9)], "s string, o string, votes int")
    kept, _ = terminology.break_cycles(votes)
    assert ("x", "z") not in {tuple(r) for r in kept.collect()}


def test_constructs_are_read_back(spark):
    p, q = Property(e("p")), Property(e("q"))
    made = [
        p.some(Named(e("A")) & ~Named(e("B"))), p.only(Named(e("A")) | Named(e("B"))), (~p).min(2, Named(e("A"))), p.max(1), p.exactly(0), p.has_self(),
        p.value(e("i")), q.value(5), constructs.OneOf((e("i"), e("j"))), q.some(Facets(base=v.INTEGER, min_inclusive=2, max_exclusive=9)), q.some(Facets(base=v.STRING, pattern="a.*", white_space="collapse")),
        q.some(constructs.OneOf((1, 2, 3))),
    ]
    w = Writer("g", "k")
    links = [("g", e(f"C{i:02}"), v.SUBCLASS if i % 2 else v.EQUIVALENT_CLASS, w.encode(x)) for i, x in enumerate(made)]
    reader = constructs.Reader(QuadStore.of_rows(spark, links + w.objs, w.datas))
    assert reader.definitions() == [(e(f"C{i:02}"), "is_a" if i % 2 else "equivalent_to", x) for i, x in enumerate(made)]
    assert reader.subclasses(p.has_self()) == [e("C05")]
    got = [render.expression(x) for _, _, x in reader.definitions()]
    assert got[:10] == ["∃ p.(A ⊓ ¬B)", "∀ p.(A ⊔ B)", "≥ 2 p⁻.A", "≤ 1 p", "= 0 p", "∃ p.Self", "∃ p.{i}", "∃ q.{5}", "{i, j}", "∃ q.integer[≥ 2, < 9]"]


def test_axioms_as_text(spark):
    s = QuadStore.of_rows(spark, [obj("A", v.SUBCLASS, "B"), obj("A", v.DISJOINT_WITH, "C"), obj("p", v.INVERSE_OF, "q"), obj("p", v.DOMAIN, "A"), obj("p", v.RANGE, "B"), obj("p", v.TYPE, v.TRANSITIVE), obj("q", v.TYPE, v.FUNCTIONAL)])
    assert render.axioms(s) == sorted(["A ⊑ B", "A ⊓ C ⊑ ⊥", "p ≡ q⁻", "∃ p.⊤ ⊑ A", "⊤ ⊑ ∀ p.B", "p ∘ p ⊑ p", "⊤ ⊑ ≤ 1 q"])


def test_restrictions_inside_an_intersection(spark):
    w = Writer("g", "x")
    objs = [("g", e("C"), v.EQUIVALENT_CLASS, w.encode(Named(e("D")) & Property(e("p")).some(Named(e("F")))))]
    got = constructs.restrictions(QuadStore.of_rows(spark, objs + w.objs, w.datas)).collect()
    assert [(r.cls, r.source, r.kind, r.filler) for r in got] == [(e("C"), "equivalent_to", "some", e("F"))]


def test_rules_are_read_printed_and_stored(spark):
    names = {x: e(x) for x in ("Person", "weight", "fat", "knows", "bob")}
    kinds = {e("Person"): "class", e("fat"): "class", e("weight"): "data", e("knows"): "object", v.INTEGER: "datatype"}
    text = 'Person(?x), weight(?x, ?w), greaterThan(?w, 90), knows(bob, ?x), stringConcat(?t, "a, b", "c") -> fat(?x)'
    rule = rules.from_text(text, names, kinds)
    assert rule == rules.Rule([rules.Cls(e("Person"), "?x"), rules.Data(e("weight"), "?x", "?w"), rules.Builtin("greaterThan", "?w", 90), rules.Obj(e("knows"), e("bob"), "?x"), rules.Builtin("stringConcat", "?t", "a, b", "c")], [rules.Cls(e("fat"), "?x")])
    assert rules.from_text(str(rule), {}, kinds) == rule
    other = rules.from_text("Person(?x), knows(?x, ?z) -> knows(?z, ?x)", names, kinds)
    one, two = rules.encode(rule, "g", "r1"), rules.encode(other, "g", "r2")
    store = QuadStore.of_rows(spark, list(dict.fromkeys(one.objs + two.objs)), one.datas + two.datas)
    assert sorted(map(str, rules.stored_rules(store).values())) == sorted([str(rule), str(other)])
    node = next(n for n, r in rules.stored_rules(store).items() if r == rule)
    left = rules.destroy_rule(store, node)
    assert list(rules.stored_rules(left).values()) == [other] and {r[0].rpartition("#")[2] for r in rules.variables(left).collect()} == {"x", "z"}
    with pytest.raises(ValueError, match="unknown name"):
        rules.from_text("Nope(?x) -> fat(?x)", names, kinds)


def test_functional_and_class_level_values(spark):
    w, p = Writer("g", "f"), Property(e("p"))
    links = [(c, w.encode(x)) for c, x in (("Animal", p.value(e("low"))), ("Dog", p.value(e("high"))), ("Dog", p.some(Named(e("F")))), ("F", p.some(Named(e("G")))), ("Animal", p.only(Named(e("A")))), ("Dog", p.only(Named(e("B")))))]
    objs = [obj("Dog", v.SUBCLASS, "Animal"), obj("rex", v.TYPE, "Dog"), obj("cat", v.TYPE, "Animal"), obj("own", v.TYPE, "Dog"), obj("own", "p", "mine")] + [("g", e(c), v.SUBCLASS, n) for c, n in links]
    s = QuadStore.of_rows(spark, objs + w.objs, w.datas)
    assert {(r.s[-3:], r.o.removeprefix(E)) for r in values.functional_value(s, e("p")).collect()} == {("rex", "F"), ("cat", "low"), ("own", "mine")}
    assert {(r.cls.removeprefix(E), r.filler.removeprefix(E)) for r in values.transitive_class_values(s, [e("p")]).collect()} >= {("Dog", "G"), ("Dog", "low"), ("F", "G")}
    assert {r.cls.removeprefix(E): [x[-1] for x in r.fillers] for r in values.class_only(s, [e("p")]).collect()} == {"Animal": ["A"], "Dog": ["A", "B"]}
    assert values.is_subclass(s, e("Dog"), e("Animal")) and not values.is_subclass(s, e("Animal"), e("Dog"))
    new = mutate.set_class_values(s, e("Dog"), e("p"), [e("X"), e("Y")])
    got = constructs.restrictions(new).where(F.col("cls") == e("Dog")).collect()
    assert {(r.kind, r.filler.removeprefix(E)) for r in got} == {("value", "high"), ("some", "X"), ("some", "Y"), ("only", "B")}


def test_clashes_of_groups_properties_and_counts(spark):
    w = Writer("g", "v")
    objs = mutate.disjoint_rows("g", [e("A"), e("B"), e("C")]) + mutate.disjoint_rows("g", [e("p"), e("q")], "properties", "pp") + mutate.disjoint_rows("g", [e("i"), e("j"), e("k")], "individuals", "ii")
    objs += [obj("x", v.TYPE, "A"), obj("x", v.TYPE, "C"), obj("y", v.TYPE, "A"), obj("a", "p", "b"), obj("a", "q", "b"), obj("i", v.SAME_AS, "m"), obj("m", v.SAME_AS, "k"), obj("y", "r", "z"), ("g", e("A"), v.SUBCLASS, w.encode(Property(e("r")).max(0)))]
    got = {(r.s.removeprefix(E), r.kind) for r in reason.violations(QuadStore.of_rows(spark, objs + w.objs, w.datas)).collect()}
    assert got == {("x", "disjoint"), ("a", "disjoint properties"), ("i", "same and different"), ("y", "too many values")}


def test_at_most_one_makes_values_the_same(spark):
    w = Writer("g", "m")
    objs = [obj("x", v.TYPE, "C"), obj("x", "p", "y1"), obj("x", "p", "y2"), obj("y2", "q", "z"), ("g", e("C"), v.SUBCLASS, w.encode(Property(e("p")).max(1)))]
    out = reason.infer(QuadStore.of_rows(spark, objs + w.objs, w.datas))
    assert out.has("objs", s=e("y1"), p=e("q"), o=e("z")) and out.has("objs", s=e("y2"), p=v.SAME_AS, o=e("y1"))


def test_fusion_types_and_equivalents(spark):
    s = QuadStore.of_rows(spark, [obj("B", v.SUBCLASS, "A"), obj("x", v.TYPE, "B"), obj("x", v.TYPE, "A"), obj("x", v.TYPE, "C"), obj("y", v.TYPE, "B"), obj("P", v.SUBCLASS, "Q"), obj("Q", v.SUBCLASS, "P")])
    assert [(r.s, r.fusion) for r in reason.fusion_types(s).collect()] == [(e("x"), "B_C")]
    assert [(r.s, r.o) for r in reason.inferred_equivalents(s).collect()] == [(e("Q"), e("P"))]


def test_mapping_and_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("a", "d")], "s string, o string")
    codes = spark.createDataFrame([("a",), ("c",)], "s string")
    assert terminology.map_concepts(codes, edges.where("o <> 'd'"), spark.createDataFrame([], "src string, dst string")).count() == 0
    got = terminology.map_concepts(codes, edges, spark.createDataFrame([("d", "X")], "src string, dst string"))
    assert {tuple(r) for r in got.collect()} == {("a", "X"), ("c", "X")}


def test_relations_and_labels_of_a_terminology(spark):
    labels = spark.createDataFrame([("T", "1", "Renal failure", ["Kidney failure"]), ("T", "2", "Cough", None), ("U", "1", "Kidney", [])], "terminology string, code string, label string, synonyms array<string>")
    assert {tuple(r) for r in terminology.search_labels(labels, "kidney*").collect()} == {("T", "1", "Renal failure"), ("U", "1", "Kidney")}
    assert terminology.search_labels(labels, "fail* -renal -kidney", "T").count() == 0 and terminology.concept(labels, "T", "2").first().label == "Cough"
    edges = spark.createDataFrame([("T/2", "T/1"), ("T/3", "T/2"), ("U/1", "T/1")], "s string, o string")
    assert [r[0] for r in terminology.terminology_roots(edges, "T").collect()] == ["T/1"]
    rel = spark.createDataFrame([("T/1", 0, "site", "a"), ("T/1", 0, "site", "b"), ("T/1", 1, "site", "c"), ("T/1", 1, "form", "d")], "s string, grp int, kind string, o string")
    assert sorted([tuple(map(tuple, r.relations)) for r in terminology.relation_groups(rel).collect()]) == [(("form", "d"), ("site", "c")), (("site", "a"),), (("site", "b"),)]
    both = spark.createDataFrame([("T/2", "T/1"), ("T/3", "T/1"), ("T/3", "T/2")], "s string, o string")
    assert {tuple(r) for r in terminology.by_generality(both, edges.select("s")).collect()} == {("T/2", 1), ("T/3", 0), ("U/1", 0)}


def test_stored_index_is_kept_in_step(spark, tmp_path):
    from quadspark.operators import fts

    shape = "s string, lex string, lang string"
    texts = [("a", "the quick brown fox", "en"), ("b", "Quick, the lazy dog", "en"), ("c", "le renard brun", "fr"), ("d", None, None), ("e", "", "en"), ("a", "fox and quick dog", "en")]
    rows = spark.createDataFrame(texts, shape)
    idx = fts.Stored.build(rows, str(tmp_path / "fts"))
    queries = ["quick", "quick the", "qui* -fox", '"quick brown"', "renard OR lazy", "NEAR(the fox, 2)", "NEAR(the fox, 1)", "brun*", '"the quick"', "zzz"]
    by_scan = lambda f, q, lang=None: sorted(r.s for r in fts.find(f, q, lang).collect())
    for q in queries:
        assert sorted(r.s for r in idx.match(q).collect()) == by_scan(rows, q), q
    assert by_scan(rows, "NEAR(the fox, 2)") == ["a"] and by_scan(rows, "NEAR(the fox, 1)") == [] and by_scan(rows, "le", "en") == []
    gone, come = rows.where("s = 'b'"), spark.createDataFrame([("f", "a quick one", "en")], shape)
    idx.refresh(come, gone)
    now = rows.where("s <> 'b'").unionByName(come)
    for q in queries:
        assert sorted(r.s for r in idx.match(q).collect()) == by_scan(now, q), q
    idx.refresh(gone)
    assert sorted(r.s for r in idx.match("quick").collect()) == ["a", "a", "b", "f"]
    with pytest.raises(ValueError):
        fts.find(rows, "(a b)")


def test_updates_of_literals_and_blank_nodes(pizza):
    from quadspark.operators.bgp import Literal

    where = Pattern(pizza).data("?p", e("price"), "?x").rows
    out = update(pizza, where, delete=[("?p", e("price"), Literal("?x"))], insert=[("?p", e("cost"), Literal("?x", v.DOUBLE)), ("?p", e("bill"), "_:b"), ("_:b", v.TYPE, e("Bill"))], graph="g")
    assert [(r.lex, r.num) for r in out.values(e("cost")).collect()] == [("9.9", 9.9)] and not out.has("datas", p=e("price"))
    assert Pattern(out).triple("?p", e("bill"), "?b").triple("?b", v.TYPE, e("Bill")).rows.count() == 1
    assert Pattern(pizza).data("?p", e("price"), "?x").minus(Pattern(pizza).triple("?a", v.SUBCLASS, "?b")).rows.count() == 1
    below = Pattern(pizza).path(e("Olive"), v.SUBCLASS, "?c").rows
    assert names(below, "c") == {"Vegetable", "Topping"}


def test_adding_keeps_branches_and_drops_repeats(pizza, spark):
    rows = spark.createDataFrame([("g", e("ma_pizza"), e("has_topping"), e("ma_tomate")), ("g", e("new"), e("has_topping"), e("ma_tomate")), ("g", e("new"), e("has_topping"), e("ma_tomate"))], "c string, s string, p string, o string")
    out = mutate.add(pizza, rows)
    assert out.objs.count() == pizza.objs.count() + 1
    note = pizza.datas.where(F.col("p") == v.COMMENT)
    assert mutate.add(pizza, None, note).datas.count() == pizza.datas.count()
    swapped = out.replace_graph("g", QuadStore(rows, pizza.datas.limit(0)))
    assert swapped.objs.count() == 2 and swapped.datas.count() == 0


def test_list_cells(spark):
    w = Writer("g", "l")
    head = w.list_of([e("a"), e("b"), e("a")])
    s = QuadStore.of_rows(spark, [("g", e("C"), v.ONE_OF, head), *w.objs], [])
    got = sorted((r.pos, r.length, r.owner, r.lst == head) for r in constructs.list_cells(s).collect())
    assert got == [(1, 3, e("C"), True), (2, 3, e("C"), True), (3, 3, e("C"), True)]


def test_closing_below_and_of_an_ontology(spark):
    objs = [obj("C", v.TYPE, v.CLASS), obj("D", v.TYPE, v.CLASS), obj("D", v.SUBCLASS, "C"), obj("x", v.TYPE, "D"), obj("x", v.TYPE, v.INDIVIDUAL), obj("p", v.TYPE, v.OBJECT_PROPERTY), obj("x", "p", "y")]
    s = QuadStore.of_rows(spark, objs)
    people, extents, closed = closing.close_ontology(s, "g")
    assert [(r.s, r.members) for r in people.collect()] == [(e("x"), [e("y")])]
    assert {(r.cls[-1], tuple(r.members)) for r in extents.collect()} == {("C", (e("x"),)), ("D", (e("x"),))}
    assert {(r.cls[-1], tuple(r.members)) for r in closed.collect()} == {("C", (e("y"),)), ("D", (e("y"),))}


def test_defined_classes_after_closing(spark):
    p, w = Property(e("p")), Writer("g", "d")
    links = [(e("None"), w.encode(~p.some(Named(e("D"))))), (e("One"), w.encode(Named(e("P")) & p.exactly(1, Named(e("D"))))), (e("Both"), w.encode(Named(e("One")) & p.min(2)))]
    objs = [("g", c, v.EQUIVALENT_CLASS, n) for c, n in links] + [obj(x, v.TYPE, v.INDIVIDUAL) for x in "abcde"] + [obj("a", "p", "d"), obj("b", "p", "d"), obj("b", "p", "e"), obj("d", v.TYPE, "D"), obj("a", v.TYPE, "P"), obj("b", v.TYPE, "P")]
    out = reason.realise_defined(QuadStore.of_rows(spark, objs + w.objs, w.datas))
    got = {(r.s[-1], r.o.removeprefix(E)) for r in out.graph(reason.INFERRED).objs.collect()}
    assert got == {("c", "None"), ("d", "None"), ("e", "None"), ("a", "One"), ("b", "One"), ("b", "Both")}


def test_small_parts_are_told_apart_without_rounds(spark, monkeypatch):
    """A prism and a Moebius ladder of eight nodes: all nodes alike, three links each."""
    ladder = lambda name, twist: [(f"_:{name}{i}", f"_:{name}{j}") for i in range(4) for j in [(i + 1) % 4 + (4 if twist and i == 3 else 0), i + 4]] + [
        (f"_:{name}{i + 4}", f"_:{name}{(i + 1) % 4 + (0 if twist and i == 3 else 4)}") for i in range(4)
    ]
    graph = lambda rows: QuadStore.of_rows(spark, [("g", a, "p", b) for a, b in rows])
    refined, real = [], diff._refined
    monkeypatch.setattr(diff, "_refined", lambda *x: refined.append(1) or real(*x))
    assert diff.diff(graph(ladder("a", False)), graph(ladder("z", False)[::-1])).isEmpty()
    assert diff.diff(graph(ladder("a", False)), graph(ladder("b", True))).count() == 24
    assert len(refined) == 2


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_facts_are_not_sorted_by_class_to_find_clashes(spark, no_small_tables):
    """All members of a class would come to one task."""
    s = QuadStore.of_rows(spark, [("g", f"{E}{i}", v.TYPE, E + "A") for i in range(9)] + [("g", E + "1", v.TYPE, E + "B"), ("g", E + "A", v.DISJOINT_WITH, E + "B")])
    found = reason.violations(s)
    assert "SortMergeJoin" not in _plan(found)
    assert [r.s for r in found.collect()] == [E + "1"]


def test_facts_are_not_sorted_by_predicate_to_infer(spark, no_small_tables):
    """All facts of a property would come to one task, and so would all members of a class."""
    rows = [("g", f"{E}{i}", E + "p", E + "x") for i in range(9)] + [("g", E + "x", v.TYPE, E + "A"), ("g", E + "A", v.SUBCLASS, E + "B"), ("g", E + "p", v.INVERSE_OF, E + "q")]
    made = reason._round(QuadStore.of_rows(spark, rows))
    assert "SortMergeJoin" not in _plan(made)
    got = {tuple(r) for r in made.where("NOT contains(p, 'subClassOf')").collect()}
    assert got == {(E + "x", E + "q", f"{E}{i}") for i in range(9)} | {(E + "x", v.TYPE, E + "B")} | ({(E + "x", v.TYPE, E + "A")} & got)


def test_a_destroy_sorts_no_triples_by_predicate(spark, no_small_tables):
    """All triples of a property would come to one task; what notes a property still falls with it."""
    axioms = [("g", f"_:a{i}", p, o) for i in range(4) for p, o in ((v.SOURCE, f"{E}s{i}"), (v.PROPERTY, E + ("p" if i < 3 else "q")), (v.TARGET, f"{E}t{i % 2}"))]
    s = QuadStore.of_rows(spark, axioms + [("g", E + "x", E + "p", E + "y"), ("g", E + "x", E + "q", E + "y")])
    left, removed = mutate.destroy(s, spark.createDataFrame([(E + "q",), (E + "t1",)], "s string"))
    assert "hashpartitioning(p#" not in _plan(left.objs) and "hashpartitioning(p#" not in _plan(left.datas)
    assert {(r.s, r.p) for r in left.objs.collect()} == {(f"_:a{i}", p) for i in (0, 2) for p in (v.SOURCE, v.PROPERTY, v.TARGET)} | {(E + "x", E + "p")}
    assert removed.objs.count() == 7


def test_a_destroy_writes_and_deals_only_what_falls(spark, no_small_tables, monkeypatch):
    """Links of named things are not all written, and triples are not dealt by objects that stay."""
    rows, real = [], mutate.checkpointed
    monkeypatch.setattr(mutate, "checkpointed", lambda f: rows.append((f := real(f)).count()) or f)
    axioms = [("g", f"_:a{i}", p, o) for i in range(300) for p, o in ((v.SOURCE, f"{E}s{i}"), (v.PROPERTY, E + "p"), (v.TARGET, f"{E}t{i % 50}"))]
    chain = [("g", "_:a7", v.SUBCLASS, "_:b0"), ("g", "_:b0", v.SUBCLASS, "_:b1"), ("g", E + "named", v.SOURCE, "_:b1"), ("g", "_:n", v.TARGET, E + "named")]
    s = QuadStore.of_rows(spark, axioms + chain)
    left, removed = mutate.destroy(s, spark.createDataFrame([(E + "t7",)], "s string"))
    assert sum(rows) < 60
    gone = {f"_:a{i}" for i in range(7, 300, 50)} | {"_:b0", "_:b1", E + "named", "_:n"}
    assert {r.s for r in left.objs.select("s").collect()} == {f"_:a{i}" for i in range(300)} - gone
    assert {tuple(r) for r in removed.objs.collect()} == {r for r in axioms + chain if r[1] in gone}


def test_a_sieve_lets_no_key_pass(spark):
    rows, keys = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("x")), spark.range(0, 9000, 3).select(F.concat(F.lit("n"), "id").alias("k"))
    maybe, sure = closure.sift(rows, "x", keys)
    assert {int(r.x[1:]) for r in maybe.collect()} >= set(range(0, 3000, 3)) and maybe.count() < 1100
    assert maybe.count() + sure.count() == 3000


def test_texts_of_classes_are_joined_in_pieces(spark, monkeypatch):
    """No task gathers the members of a class one by one."""
    monkeypatch.setattr(closing, "PIECE", 4)
    rows = [(f"c{i % 3}", f"m{i}") for i in range(50)] * 2 + [("one", "x"), ("one", None), ("none", None)]
    got = closing.texts_of(spark.createDataFrame(rows, "cls string, member string").repartition(5), "cls", "member")
    want = {c: ",".join(sorted({m for k, m in rows if k == c and m})) for c in ("c0", "c1", "c2", "one")}
    assert {r.cls: r.text for r in got.collect()} == want
    plan = _plan(QUERIES["close_classes"](spark, "/root/testdata/sf0.001"))
    assert "collect_set" not in plan and "_piece" in plan
