import pytest
from pyspark.sql import functions as F

from quadspark.functions import vocab as v
from quadspark.functions.builtins import BUILTINS
from quadspark.functions.terms import Loc, glob_regex, matches_glob, tokens, typed
from quadspark.sources import ntriples, rdfxml, rrf
from quadspark.sources.store import QuadStore
from quadspark.streaming import changes

TRIPLES = [
    '<http://e/a> <http://e/p> <http://e/b> .',
    '_:x <http://e/q> "l\\"i\\nne\\\\" .',
    '<http://e/a> <http://e/q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    '<http://e/a> <http://e/q> "été"@fr .',
]
RDF = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://e/onto" xmlns:e="http://e/onto#">
<owl:Class rdf:about="#A"><rdfs:subClassOf><owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="#B"/><rdf:Description rdf:about="#C"/></owl:unionOf></owl:Class></rdfs:subClassOf></owl:Class>
<e:A rdf:ID="a"><e:price rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:price><rdfs:label xml:lang="en">an a</rdfs:label></e:A>
</rdf:RDF>"""
OWLXML = """<?xml version="1.0"?>
<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://e/o">
<Prefix name="e" IRI="http://e/o#"/>
<Declaration><Class IRI="#A"/></Declaration>
<SubClassOf><Class IRI="#A"/><ObjectSomeValuesFrom><ObjectProperty abbreviatedIRI="e:p"/><Class IRI="#B"/></ObjectSomeValuesFrom></SubClassOf>
<DisjointClasses><Class IRI="#A"/><Class IRI="#B"/><Class IRI="#C"/></DisjointClasses>
<SubObjectPropertyOf><ObjectPropertyChain><ObjectProperty IRI="#p"/><ObjectProperty IRI="#q"/></ObjectPropertyChain><ObjectProperty IRI="#p"/></SubObjectPropertyOf>
<DataPropertyAssertion><DataProperty IRI="#age"/><NamedIndividual IRI="#a"/><Literal datatypeIRI="http://www.w3.org/2001/XMLSchema#integer">7</Literal></DataPropertyAssertion>
</Ontology>"""


def test_ntriples_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.nt")
    open(path, "w").write("# comment\n\n" + "\n".join(TRIPLES) + "\n")
    store = ntriples.read(spark, path, "g")
    assert store.objs.count() == 1 and store.datas.count() == 3
    assert store.scan("datas", d=v.INTEGER).first().num == 5
    assert {r.lex for r in store.datas.collect()} == {'l"i\nne\\', "5", "été"}
    lines = {r[0] for r in ntriples.lines(store).collect()}
    assert set(TRIPLES) - {TRIPLES[1]} <= lines and len(lines) == 4
    again = ntriples.parse_lines(ntriples.lines(store), "g", "line")
    assert again.objs.exceptAll(store.objs).isEmpty() and again.scan("datas", lang="fr").count() == 1


def test_malformed_line_fails(spark):
    bad = ntriples.parse_lines(spark.createDataFrame([("<a> <b> .",)], "value string"), "g")
    with pytest.raises(Exception, match="malformed"):
        bad.quads.collect()


def test_rdfxml(spark, tmp_path):
    path = tmp_path / "a.owl"
    path.write_text(RDF)
    store = rdfxml.read(spark, str(path), "g")
    got = {(r.s, r.p, r.o) for r in store.objs.collect()}
    assert ("http://e/onto#a", v.TYPE, "http://e/onto#A") in got and ("http://e/onto#A", v.TYPE, v.CLASS) in got
    assert [r.num for r in store.values("http://e/onto#price").collect()] == [5.0]
    from quadspark.operators.constructs import lists

    assert [r.item for r in lists(store).orderBy("pos").collect()] == ["http://e/onto#B", "http://e/onto#C"]
    xml = "".join([rdfxml.HEAD, *(r.xml for r in rdfxml.description_rows(store).collect()), rdfxml.TAIL])
    from quadspark.operators.diff import diff

    back = rdfxml.of_rows(spark.createDataFrame(rdfxml.parse_rdfxml(xml, "http://e/", "z"), rdfxml.ROW), "g")
    assert diff(store, back).count() == 0
    path.write_text(RDF.replace("</e:A>", ""))
    with pytest.raises(Exception, match="line"):
        rdfxml.read(spark, str(path), "g").objs.collect()


def test_owlxml(spark, tmp_path):
    path = tmp_path / "b.owl"
    path.write_text(OWLXML)
    store = rdfxml.read(spark, str(path), "g")
    from quadspark.operators.constructs import lists, restrictions

    assert [(r.cls, r.kind, r.filler) for r in restrictions(store).collect()] == [("http://e/o#A", "some", "http://e/o#B")]
    assert sorted(r.n for r in lists(store).groupBy("lst").agg(F.count("*").alias("n")).collect()) == [2, 3]
    assert store.values("http://e/o#age").first().num == 7


def test_snapshot(spark, tmp_path):
    store = QuadStore.of_rows(spark, [("g", "a", "p", "b"), ("g", "p", v.INVERSE_OF, "q")], [("g", "a", "d", "1", 1.0, v.INTEGER, None)])
    store.save(str(tmp_path / "s"))
    again = QuadStore.load(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in again.objs.collect()} == {tuple(r) for r in store.objs.collect()} and again.inverses == {"p": "q", "q": "p"}
    assert {r.s for r in again.pairs("q").collect()} == {"b"}


def test_terms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(tokens(F.lit("Rénale, œdème  X2"))) == ["renale", "d", "me", "x2"] or "renale" in value(tokens(F.lit("Rénale")))
    assert value(typed(v.INTEGER, F.lit("x"))) is None and value(typed(v.TIME, F.lit("01:02:03"))) == 3723
    assert glob_regex("a*[bc]?") == "(?s)^a.*[bc].$"
    assert value(matches_glob(F.lit("50% x"), "50% *", False)) and not value(matches_glob(F.lit("50 x"), "50% *", False))
    assert Loc("a", "en").lang == "en"


def test_builtins(spark):
    assert len(BUILTINS) == 79
    one = spark.range(1)
    value = lambda name, *x: one.select(BUILTINS[name](*(F.lit(y) for y in x)).alias("x")).first().x
    assert value("round", -2.5) == -2 and value("roundHalfToEven", 2.5) == 2 and value("integerDivide", 7, 2) == 3 and value("divide", 1, 0) is None
    assert value("substringBefore", "tattoo", "attoo") == "t" and value("substringAfter", "tattoo", "tat") == "too" and value("substringAfter", "a", "z") == ""
    assert value("matches", "abc", "a.*") and not value("matches", "xabc", "a.*")
    assert value("normalizeSpace", "  a  b ") == "a b" and value("translate", "bar", "abc", "AB") == "BAr"
    assert str(value("addYearMonthDurationToDate", __import__("datetime").date(2020, 1, 31), 1)) == "2020-02-29"
    assert value("resolveURI", "b", "http://x/a") == "http://x/b" and value("stringConcat", "a", "b", "c") == "abc"


def test_rrf(spark, tmp_path):
    (tmp_path / "c.RRF").write_text("C1|ENG|P|L|S|U|Y|A1|||D|T|PT|10|ten|0|N||\nC1|ENG|P|L|S|U|Y|A2|||D|T|SY|10|dix|0|N||\nC1|ENG|P|L|S|U|Y|A3|||D|T|SY|10|gone|0|O||\nC2|ENG|P|L|S|U|Y|A4|||D|T|PT|20|twenty|0|N||\n")
    (tmp_path / "r.RRF").write_text("1|T|SY|N|\n9|T|PT|N|\n")
    (tmp_path / "e.RRF").write_text("C1|A1||PAR|C2|A4|||||T|||Y|N||\n")
    conso = rrf.read(spark, str(tmp_path / "c.RRF"), "MRCONSO")
    found = {r.code: (r.label, r.synonyms) for r in rrf.concepts(conso, rrf.read(spark, str(tmp_path / "r.RRF"), "MRRANK")).collect()}
    assert found == {"10": ("ten", ["dix"]), "20": ("twenty", [])}
    parents, _ = rrf.relations(rrf.read(spark, str(tmp_path / "e.RRF"), "MRREL"), conso)
    assert [tuple(r) for r in parents.collect()] == [("T/10", "T/20")]


def test_change_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01 00:10:00", 1, "a", 1.0), (2, "2020-01-01 00:20:00", 1, "b", 1.0), (3, "2020-01-01 05:00:00", 2, "a", 1.0)], "seq long, t string, s long, p string, o double")
    rows.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, s long, p string, o double, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    out = changes.collapsed_stream(stream).writeStream.format("memory").queryName("collapsed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    out.processAllAvailable()
    out.stop()
    assert {(r.s, r.preds) for r in spark.table("collapsed").collect()} == {(1, "a,b"), (2, "a")}
    seen = []
    q = changes.observe(stream, lambda batch, i: seen.extend(r.seq for r in batch.collect()), str(tmp_path / "cp2"), [1])
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 2]


def test_library_reads_imports_and_newer_files(spark, tmp_path):
    import os

    from quadspark.functions import vocab as v
    from quadspark.sources.library import Library, base_iri

    def put(name, *rows):
        (tmp_path / name).write_text("".join(f"<{s}> <{p}> <{o}> .\n" for s, p, o in rows))

    o = lambda x: f"http://x/{x}"
    put("a.nt", (o("a"), v.IMPORTS, o("b")), (o("a") + "#k", v.TYPE, v.CLASS))
    put("b.ntriples", (o("b"), v.IMPORTS, o("a")), (o("b") + "#m", v.TYPE, v.CLASS))
    library = Library(spark, str(tmp_path / "kept"), [str(tmp_path)])
    both = library.load(o("a"))
    assert {r[0] for r in both.scan("objs", p=v.TYPE).select("c").collect()} == {o("a"), o("b")}
    assert library.load(o("a"), imports=False).objs.count() == 2 and base_iri(both, o("a")) == o("a") + "#"
    put("b.ntriples", (o("b") + "#new", v.TYPE, v.CLASS))
    os.utime(tmp_path / "b.ntriples", (2_000_000_000, 2_000_000_000))
    assert library.load(o("a")).has(s=o("b") + "#m") and library.load(o("a"), reload_if_newer=True).has(s=o("b") + "#new")
    assert not library.load(o("b")).has(s=o("b") + "#m")
    with pytest.raises(FileNotFoundError):
        library.load(o("none"))


def test_rrf_folder(spark, tmp_path):
    from quadspark.functions import vocab as v
    from quadspark.sources import rrf

    def put(kind, *rows):
        n = len(rrf.COLUMNS[kind].split())
        (tmp_path / f"{kind}.RRF").write_text("".join("|".join([*(row.get(c, "") for c in rrf.COLUMNS[kind].split())]) + "|\n" for row in rows))
        return n

    put("MRRANK", {"rank": "9", "terminology": "T", "tty": "PT"}, {"rank": "3", "terminology": "T", "tty": "SY"})
    conso = lambda aui, cui, tty, code, term, suppress="N", t="T": {"aui": aui, "cui": cui, "terminology": t, "tty": tty, "code": code, "term": term, "lang": "ENG", "suppress": suppress}
    put("MRCONSO", conso("A1", "C1", "SY", "1", "kidney trouble"), conso("A2", "C1", "PT", "1", "renal failure"), conso("A3", "C2", "PT", "2", "acute one"), conso("A4", "C3", "PT", "3", "gone", "O"), conso("A5", "C1", "PT", "9", "nier", t="U"))
    put("MRREL", {"cui1": "C2", "aui1": "A3", "rel": "PAR", "cui2": "C1", "aui2": "A2", "suppress": "N"}, {"rel": "RO", "rela": "site_of", "cui2": "C1", "aui2": "A2", "direct": "Y", "suppress": "N"})
    put("MRSAT", {"metaui": "A2", "atn": "STATUS", "atv": "x", "suppress": "N"})
    put("MRDEF", {"aui": "A2", "def": "what it is", "suppress": "N"})
    store = rrf.load(spark, str(tmp_path), filled=True)
    u = rrf.U
    assert {(r.s.removeprefix(u), r.lex) for r in store.values(v.LABEL).collect()} == {("T/1", "renal failure"), ("T/2", "acute one"), ("U/9", "nier")}
    assert [(r.s.removeprefix(u), r.lex) for r in store.values(u + "synonyms").collect()] == [("T/1", "kidney trouble")]
    assert [(r.s.removeprefix(u), r.o.removeprefix(u)) for r in store.scan("objs", p=v.SUBCLASS).collect()] == [("T/2", "T/1")]
    assert [(r.s.removeprefix(u), r.o.removeprefix(u)) for r in store.scan("objs", p=u + "site_of").collect()] == [("T/1", "T/2")]
    assert store.has("datas", s=u + "T/1", p=u + "STATUS", lex="x") and store.has("datas", s=u + "T/1", p=u + "definition")
    assert {r[0] for r in store.scan("objs", p=u + "mapped_to", o=u + "CUI/C1").select("s").collect()} == {u + "T/1", u + "U/9"}


def test_intervals_of_text_codes(spark):
    from quadspark.sources import rrf

    codes = spark.createDataFrame([(x,) for x in ("A00", "A09.3", "A15", "B99", "C00", "B05-B09")], "s string")
    groups = spark.createDataFrame([("A00-B99", "A00", "B99"), ("A00-A09", "A00", "A09"), ("B05-B09", "B05", "B09")], "parent string, low string, high string")
    got = {r.s: r.parent for r in rrf.interval_of_text(codes, groups).collect()}
    assert got == {"A00": "A00-A09", "A09.3": "A00-A09", "A15": "A00-B99", "B99": "A00-B99", "B05-B09": "A00-B99"}


def test_owlxml_keys_and_negative_assertions(spark, tmp_path):
    from quadspark.functions import vocab as v
    from quadspark.sources import rdfxml

    text = '''<?xml version="1.0"?><Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://o">
    <HasKey><Class IRI="http://o/C"/><ObjectProperty IRI="http://o/p"/></HasKey>
    <NegativeDataPropertyAssertion><DataProperty IRI="http://o/d"/><NamedIndividual IRI="http://o/i"/><Literal>5</Literal></NegativeDataPropertyAssertion></Ontology>'''
    (tmp_path / "o.owl").write_text(text)
    s = rdfxml.read(spark, str(tmp_path / "o.owl"), "g")
    assert s.has("objs", s="http://o/C", p=v.OWL + "hasKey") and s.has("datas", p=v.OWL + "targetValue", lex="5")


def test_rdfxml_files_round_trip(spark, tmp_path):
    from quadspark.sources import rdfxml
    from quadspark.sources.store import QuadStore

    store = QuadStore.of_rows(spark, [("g", f"http://x/s{i}", "http://x/p", f"http://x/o{i % 3}") for i in range(30)], [("g", "http://x/s1", "http://x/d", 'a <b> & "c"', None, "http://www.w3.org/2001/XMLSchema#string", None)])
    rdfxml.write(store, str(tmp_path / "out"), subjects_a_file=10)
    back = rdfxml.read(spark, str(tmp_path / "out"), "g")
    assert {tuple(r) for r in back.objs.collect()} == {tuple(r) for r in store.objs.collect()}
    assert {tuple(r) for r in back.datas.collect()} == {tuple(r) for r in store.datas.collect()}


def test_fill_down_over_the_blocks_of_a_file(spark, tmp_path):
    rows = [(f"C{i // 7}" if i % 7 == 0 else "", "A1" if i == 0 else "", str(i)) for i in range(200)]
    n = len(rrf.COLUMNS["MRREL"].split())
    (tmp_path / "MRREL.RRF").write_text("".join("|".join([a, b, c, *[""] * (n - 3), ""]) + "\n" for a, b, c in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = rrf.read(spark, str(tmp_path / "MRREL.RRF"), "MRREL", filled=True)
        assert read.select("block").distinct().count() > 3
        assert sorted((int(r.stype1), r.cui1, r.aui1) for r in read.collect()) == [(i, f"C{i // 7}", "A1") for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
