"""RDF/XML and OWL/XML files: one file for each task, read with the standard XML parser.

A file is parsed whole before its rows are given out, so a malformed one fails
without leaving a part of itself behind. Rows are (s, p, o, lex, d, lang).
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.terms import number
from .store import QuadStore

XML = "{http://www.w3.org/XML/1998/namespace}"
ROW = "s string, p string, o string, lex string, d string, lang string"
Row = tuple  # (s, p, o, lex, d, lang)


def _plain(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Rdf:
    """Node and property elements in turns, with the attributes that name, type and nest them."""

    def __init__(self, base: str, scope: str):
        self.base, self.scope, self.rows, self.n = base, scope, [], 0
        self.labels: dict[str, str] = {}

    def blank(self, label: str | None = None) -> str:
        if label is not None and label in self.labels:
            return self.labels[label]
        self.n += 1
        name = f"_:{self.scope}{self.n}"
        if label is not None:
            self.labels[label] = name
        return name

    def iri(self, text: str, base: str) -> str:
        out = text if "://" in text or text.startswith("urn:") else urljoin(base, text) if text else base
        return out.rstrip("/") if out.count("/") > 2 else out

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        rdf = f"{{{v.RDF}}}"
        about, ident, label = e.get(rdf + "about"), e.get(rdf + "ID"), e.get(rdf + "nodeID")
        s = self.iri(about, base) if about is not None else self.iri("#" + ident, base) if ident is not None else self.blank(label)
        if _plain(e.tag) != v.RDF + "Description":
            self.rows.append((s, v.TYPE, _plain(e.tag), None, None, None))
        for k, x in e.attrib.items():
            if not k.startswith((rdf, XML)) and k.startswith("{"):
                self.rows.append((s, _plain(k), None, x, v.PLAIN if lang else v.STRING, lang))
            elif k == rdf + "type":
                self.rows.append((s, v.TYPE, self.iri(x, base), None, None, None))
        for child in e:
            self.property(s, child, base, lang)
        return s

    def property(self, s: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        rdf, p = f"{{{v.RDF}}}", _plain(e.tag)
        resource, label, kind = e.get(rdf + "resource"), e.get(rdf + "nodeID"), e.get(rdf + "parseType")
        children = list(e)
        if resource is not None:
            o = self.iri(resource, base)
        elif label is not None:
            o = self.blank(label)
        elif kind == "Collection":
            o = self.collection([self.node(c, base, lang) for c in children])
        elif kind == "Resource":
            o = self.blank()
            for c in children:
                self.property(o, c, base, lang)
        elif children:
            o = self.node(children[0], base, lang)
        else:
            d = e.get(rdf + "datatype")
            d = self.iri(d, base) if d else v.PLAIN if lang else v.STRING
            self.rows.append((s, p, None, e.text or "", d, lang if d == v.PLAIN else None))
            return
        self.rows.append((s, p, o, None, None, None))

    def collection(self, items: list[str]) -> str:
        if not items:
            return v.NIL
        cells = [self.blank() for _ in items]
        for cell, item, after in zip(cells, items, [*cells[1:], v.NIL], strict=True):
            self.rows += [(cell, v.FIRST, item, None, None, None), (cell, v.REST, after, None, None, None)]
        return cells[0]


def parse_rdfxml(text: str, base: str, scope: str) -> list[Row]:
    root = ET.fromstring(text)
    r = _Rdf(root.get(XML + "base", base), scope)
    nodes = list(root) if _plain(root.tag) == v.RDF + "RDF" else [root]
    for e in nodes:
        r.node(e, r.base, root.get(XML + "lang"))
    return r.rows


# Element names of OWL/XML and the predicates they stand for.
_DECLARED = {
    "Class": v.CLASS, "ObjectProperty": v.OBJECT_PROPERTY, "DataProperty": v.DATA_PROPERTY, "AnnotationProperty": v.ANNOTATION_PROPERTY,
    "NamedIndividual": v.INDIVIDUAL, "Datatype": v.RDFS + "Datatype",
}
_BINARY = {
    "SubClassOf": v.SUBCLASS, "SubObjectPropertyOf": v.SUBPROPERTY, "SubDataPropertyOf": v.SUBPROPERTY, "SubAnnotationPropertyOf": v.SUBPROPERTY,
    "ObjectPropertyDomain": v.DOMAIN, "DataPropertyDomain": v.DOMAIN, "ObjectPropertyRange": v.RANGE, "DataPropertyRange": v.RANGE,
    "AnnotationPropertyDomain": v.DOMAIN, "AnnotationPropertyRange": v.RANGE, "InverseObjectProperties": v.INVERSE_OF,
}
_CHAINED = {"EquivalentClasses": v.EQUIVALENT_CLASS, "EquivalentObjectProperties": v.EQUIVALENT_PROPERTY, "EquivalentDataProperties": v.EQUIVALENT_PROPERTY, "SameIndividual": v.SAME_AS}
_APART = {
    "DisjointClasses": (v.DISJOINT_WITH, v.ALL_DISJOINT_CLASSES, v.MEMBERS), "DisjointObjectProperties": (v.PROPERTY_DISJOINT, v.ALL_DISJOINT_PROPERTIES, v.MEMBERS),
    "DisjointDataProperties": (v.PROPERTY_DISJOINT, v.ALL_DISJOINT_PROPERTIES, v.MEMBERS), "DifferentIndividuals": (v.DIFFERENT_FROM, v.ALL_DIFFERENT, v.DISTINCT_MEMBERS),
}
_KINDS = {
    "FunctionalObjectProperty": v.FUNCTIONAL, "FunctionalDataProperty": v.FUNCTIONAL, "InverseFunctionalObjectProperty": v.INVERSE_FUNCTIONAL,
    "TransitiveObjectProperty": v.TRANSITIVE, "SymmetricObjectProperty": v.SYMMETRIC, "AsymmetricObjectProperty": v.ASYMMETRIC,
    "ReflexiveObjectProperty": v.REFLEXIVE, "IrreflexiveObjectProperty": v.IRREFLEXIVE,
}
_QUANTIFIED = {"SomeValuesFrom": v.SOME, "AllValuesFrom": v.ONLY, "HasValue": v.VALUE}
_COUNTED = {"ExactCardinality": "cardinality", "MinCardinality": "minCardinality", "MaxCardinality": "maxCardinality"}


class _Owl(_Rdf):
    def __init__(self, base: str, scope: str, prefixes: dict[str, str]):
        super().__init__(base, scope)
        self.prefixes = prefixes

    def add(self, s: str, p: str, o: str) -> str:
        self.rows.append((s, p, o, None, None, None))
        return s

    def named(self, e: ET.Element) -> str:
        short = e.get("abbreviatedIRI")
        if short is not None:
            prefix, _, rest = short.partition(":")
            return self.prefixes.get(prefix, prefix + ":") + rest
        if e.get("nodeID") is not None:
            return self.blank(e.get("nodeID"))
        return self.iri(e.get("IRI") if e.get("IRI") is not None else (e.text or "").strip(), self.base)

    def literal(self, s: str, p: str, e: ET.Element) -> None:
        lang = e.get(XML + "lang")
        self.rows.append((s, p, None, e.text or "", e.get("datatypeIRI") or (v.PLAIN if lang else v.STRING), lang))

    def put(self, s: str, p: str, e: ET.Element) -> None:
        if _tag(e) == "Literal":
            self.literal(s, p, e)
        else:
            self.add(s, p, self.term(e))

    def term(self, e: ET.Element) -> str:
        """The node of an expression."""
        name, kids = _tag(e), list(e)
        if name in _DECLARED or name in ("IRI", "AbbreviatedIRI", "AnonymousIndividual"):
            if name == "AbbreviatedIRI":
                prefix, _, rest = (e.text or "").partition(":")
                return self.prefixes.get(prefix, prefix + ":") + rest
            return self.named(e)
        node = self.blank()
        if name in ("ObjectIntersectionOf", "DataIntersectionOf", "ObjectUnionOf", "DataUnionOf"):
            self.add(node, v.TYPE, v.CLASS if name.startswith("Object") else v.RDFS + "Datatype")
            return self.add(node, v.INTERSECTION if "Intersection" in name else v.UNION, self.collection([self.term(k) for k in kids]))
        if name in ("ObjectComplementOf", "DataComplementOf"):
            self.add(node, v.TYPE, v.CLASS)
            return self.add(node, v.COMPLEMENT, self.term(kids[0]))
        if name in ("ObjectOneOf", "DataOneOf"):
            self.add(node, v.TYPE, v.CLASS if name == "ObjectOneOf" else v.RDFS + "Datatype")
            return self.add(node, v.ONE_OF, self.list_of(kids))
        if name == "ObjectInverseOf":
            return self.add(node, v.INVERSE_OF, self.term(kids[0]))
        if name == "DatatypeRestriction":
            self.add(node, v.TYPE, v.RDFS + "Datatype")
            self.add(node, v.OWL + "onDatatype", self.term(kids[0]))
            facets = []
            for k in kids[1:]:
                facets.append(self.blank())
                self.literal(facets[-1], k.get("facet"), k[0])
            return self.add(node, v.OWL + "withRestrictions", self.collection(facets))
        kind = name.removeprefix("Object").removeprefix("Data")
        self.add(node, v.TYPE, v.RESTRICTION)
        self.add(node, v.ON_PROPERTY, self.term(kids[0]))
        if kind in _QUANTIFIED:
            self.put(node, _QUANTIFIED[kind], kids[1])
        elif kind == "HasSelf":
            self.rows.append((node, v.HAS_SELF, None, "true", v.BOOLEAN, None))
        elif kind in _COUNTED:
            p = _COUNTED[kind]
            p = p if len(kids) == 1 else "qualifiedCardinality" if p == "cardinality" else p.replace("Cardinality", "QualifiedCardinality")
            self.rows.append((node, v.OWL + p, None, e.get("cardinality"), v.XSD + "nonNegativeInteger", None))
            if len(kids) > 1:
                self.add(node, v.ON_CLASS if name.startswith("Object") else v.OWL + "onDataRange", self.term(kids[1]))
        else:
            raise ValueError(f"unknown expression {name}")
        return node

    def list_of(self, kids: list[ET.Element]) -> str:
        if not kids:
            return v.NIL
        cells = [self.blank() for _ in kids]
        for cell, k, after in zip(cells, kids, [*cells[1:], v.NIL], strict=True):
            self.put(cell, v.FIRST, k)
            self.add(cell, v.REST, after)
        return cells[0]

    def axiom(self, e: ET.Element) -> None:
        name, notes = _tag(e), [k for k in e if _tag(k) == "Annotation"]
        kids = [k for k in e if _tag(k) != "Annotation"]
        if name == "Declaration":
            self.add(self.named(kids[0]), v.TYPE, _DECLARED[_tag(kids[0])])
        elif name == "SubObjectPropertyOf" and _tag(kids[0]) == "ObjectPropertyChain":
            self.add(self.term(kids[1]), v.CHAIN, self.collection([self.term(k) for k in kids[0]]))
        elif name in _BINARY:
            self.noted(self.term(kids[0]), _BINARY[name], kids[1], notes)
        elif name in _CHAINED:
            nodes = sorted((self.term(k) for k in kids), key=lambda x: x.startswith("_:"))
            for a, b in zip(nodes, nodes[1:], strict=False):
                self.add(a, _CHAINED[name], b)
        elif name in _APART:
            pair, kind, members = _APART[name]
            nodes = [self.term(k) for k in kids]
            if len(nodes) == 2:
                self.add(nodes[0], pair, nodes[1])
            else:
                node = self.add(self.blank(), v.TYPE, kind)
                self.add(node, members, self.collection(nodes))
        elif name == "DisjointUnion":
            self.add(self.term(kids[0]), v.OWL + "disjointUnionOf", self.collection([self.term(k) for k in kids[1:]]))
        elif name in _KINDS:
            self.add(self.term(kids[0]), v.TYPE, _KINDS[name])
        elif name == "ClassAssertion":
            self.add(self.term(kids[1]), v.TYPE, self.term(kids[0]))
        elif name in ("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"):
            self.noted(self.term(kids[1]), self.term(kids[0]), kids[2], notes)
        elif name == "Import":
            self.add(self.base, v.IMPORTS, (e.text or "").strip())
        elif name == "Annotation":
            self.put(self.base, self.term(kids[0]), kids[1])
        elif name == "HasKey":
            self.add(self.term(kids[0]), v.OWL + "hasKey", self.collection([self.term(k) for k in kids[1:]]))
        elif name == "DatatypeDefinition":
            self.add(self.term(kids[0]), v.EQUIVALENT_CLASS, self.term(kids[1]))
        elif name in ("NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion"):
            node = self.add(self.blank(), v.TYPE, v.OWL + "NegativePropertyAssertion")
            self.add(node, v.OWL + "assertionProperty", self.term(kids[0]))
            self.add(node, v.OWL + "sourceIndividual", self.term(kids[1]))
            self.put(node, v.OWL + ("targetIndividual" if "Object" in name else "targetValue"), kids[2])
        elif name != "Prefix":
            raise ValueError(f"unknown axiom {name}")

    def noted(self, s: str, p: str, target: ET.Element, notes: list[ET.Element]) -> None:
        self.put(s, p, target)
        if notes:
            node = self.add(self.blank(), v.TYPE, v.AXIOM)
            self.add(node, v.SOURCE, s)
            self.add(node, v.PROPERTY, p)
            _, _, o, lex, d, lang = next(r for r in reversed(self.rows) if r[:2] == (s, p))
            self.rows.append((node, v.TARGET, o, lex, d, lang))
            for n in notes:
                self.put(node, self.term(n[0]), n[1])


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_owlxml(text: str, base: str, scope: str) -> list[Row]:
    root = ET.fromstring(text)
    prefixes = {"owl": v.OWL, "rdf": v.RDF, "rdfs": v.RDFS, "xsd": v.XSD} | {e.get("name"): e.get("IRI") for e in root if _tag(e) == "Prefix"}
    r = _Owl(root.get("ontologyIRI") or root.get(XML + "base", base), scope, prefixes)
    r.add(r.base, v.TYPE, v.ONTOLOGY)
    for e in root:
        r.axiom(e)
    return r.rows


def sniff(head: str) -> str:
    """ntriples, owlxml or rdfxml from the beginning of a file."""
    head = head.lstrip("﻿").lstrip()
    if not head.startswith("<"):
        return "ntriples"
    if head.startswith("<http") or "." in head.split("\n", 1)[0] and not head.startswith("<?") and head.split("\n", 1)[0].rstrip().endswith("."):
        return "ntriples"
    return "owlxml" if "<Ontology" in head or "<owl:Ontology" not in head and "ontologyIRI" in head else "rdfxml"


def read(spark: SparkSession, path: str, graph: str, base: str = "http://base/") -> QuadStore:
    """A store from RDF/XML or OWL/XML files; the format is told from each file's beginning."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                text = bytes(content).decode("utf-8-sig")
                scope = hashlib.blake2b(name.encode(), digest_size=6).hexdigest() + "-"
                reader: Callable = parse_owlxml if sniff(text[:1000]) == "owlxml" else parse_rdfxml
                try:
                    rows = reader(text, base, scope)
                except ET.ParseError as error:
                    raise ValueError(f"{name}, line {error.position[0]}: {error}") from error
                yield pd.DataFrame(rows, columns=["s", "p", "o", "lex", "d", "lang"])

    return of_rows(files.mapInPandas(parse, ROW), graph)


def of_rows(rows: DataFrame, graph: str) -> QuadStore:
    c = F.lit(graph).alias("c")
    objs = rows.where("o IS NOT NULL").select(c, "s", "p", "o").dropDuplicates()
    datas = rows.where("o IS NULL").select(c, "s", "p", "lex", number(F.col("lex"), F.col("d")).alias("num"), "d", "lang").dropDuplicates()
    return QuadStore(objs, datas)


def description_rows(store: QuadStore) -> DataFrame:
    """(s, xml): one rdf:Description for each subject, for an RDF/XML document between ``HEAD`` and ``TAIL``."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)$", 1)
    space = F.substring(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    blank = lambda x, name: F.when(F.startswith(x, F.lit("_:")), F.concat(F.lit(' rdf:nodeID="n'), F.regexp_replace(F.substring(x, F.lit(3), F.length(x)), "[^A-Za-z0-9]", "_"), F.lit('"'))).otherwise(F.concat(F.lit(f' rdf:{name}="'), esc(x), F.lit('"')))
    opening = F.concat(F.lit("<x:"), local, F.lit(' xmlns:x="'), esc(space), F.lit('"'))
    obj = F.concat(opening, blank(F.col("o"), "resource"), F.lit("/>"))
    mark = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "lang", F.lit('"'))).when(F.col("d") == v.STRING, "").otherwise(F.concat(F.lit(' rdf:datatype="'), esc(F.col("d")), F.lit('"')))
    lit = F.concat(opening, mark, F.lit(">"), esc(F.col("lex")), F.lit("</x:"), local, F.lit(">"))
    each = store.quads.select("s", "p", F.when(F.col("o").isNotNull(), obj).otherwise(lit).alias("xml"))
    return each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "xml"))).alias("parts")).select(
        "s", F.concat(F.lit("<rdf:Description"), blank(F.col("s"), "about"), F.lit(">"), F.array_join(F.transform("parts", lambda x: x["xml"]), ""), F.lit("</rdf:Description>")).alias("xml")
    )


HEAD = f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{v.RDF}">'
TAIL = "</rdf:RDF>"


def write(store: QuadStore, path: str, subjects_a_file: int = 100_000) -> None:
    """RDF/XML documents, one a file, of about ``subjects_a_file`` subjects each in the order of their names."""
    rows = description_rows(store)
    files = max(1, -(-rows.count() // subjects_a_file))
    dealt = rows.withColumn("file", F.pmod(F.xxhash64("s"), F.lit(files)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s", "xml"))), lambda x: x["xml"])
    whole = dealt.groupBy("file").agg(F.concat(F.lit(HEAD), F.array_join(parts, "\n"), F.lit(TAIL)).alias("value"))
    whole.repartition(files, "file").write.mode("overwrite").partitionBy("file").text(path)
