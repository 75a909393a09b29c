"""Vocabulary: the public RDF, RDFS, OWL, XSD and SWRL names that the engine reads."""

from __future__ import annotations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SWRL = "http://www.w3.org/2003/11/swrl#"

TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"
CLASS, THING, NOTHING, INDIVIDUAL = OWL + "Class", OWL + "Thing", OWL + "Nothing", OWL + "NamedIndividual"
OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"
FUNCTIONAL, INVERSE_FUNCTIONAL = OWL + "FunctionalProperty", OWL + "InverseFunctionalProperty"
TRANSITIVE, SYMMETRIC = OWL + "TransitiveProperty", OWL + "SymmetricProperty"
ASYMMETRIC, REFLEXIVE, IRREFLEXIVE = OWL + "AsymmetricProperty", OWL + "ReflexiveProperty", OWL + "IrreflexiveProperty"
EQUIVALENT_CLASS, EQUIVALENT_PROPERTY, SAME_AS, DIFFERENT_FROM = OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "sameAs", OWL + "differentFrom"
DISJOINT_WITH, PROPERTY_DISJOINT, INVERSE_OF = OWL + "disjointWith", OWL + "propertyDisjointWith", OWL + "inverseOf"
ALL_DISJOINT_CLASSES, ALL_DISJOINT_PROPERTIES, ALL_DIFFERENT = OWL + "AllDisjointClasses", OWL + "AllDisjointProperties", OWL + "AllDifferent"
MEMBERS, DISTINCT_MEMBERS = OWL + "members", OWL + "distinctMembers"
AXIOM, SOURCE, PROPERTY, TARGET = OWL + "Axiom", OWL + "annotatedSource", OWL + "annotatedProperty", OWL + "annotatedTarget"
RESTRICTION, ON_PROPERTY, ON_CLASS = OWL + "Restriction", OWL + "onProperty", OWL + "onClass"
SOME, ONLY, VALUE, HAS_SELF = OWL + "someValuesFrom", OWL + "allValuesFrom", OWL + "hasValue", OWL + "hasSelf"
CARDINALITIES = {
    OWL + "cardinality": "exactly", OWL + "minCardinality": "min", OWL + "maxCardinality": "max",
    OWL + "qualifiedCardinality": "exactly", OWL + "minQualifiedCardinality": "min", OWL + "maxQualifiedCardinality": "max",
}
COMPLEMENT, UNION, INTERSECTION, ONE_OF, CHAIN = OWL + "complementOf", OWL + "unionOf", OWL + "intersectionOf", OWL + "oneOf", OWL + "propertyChainAxiom"
ONTOLOGY, IMPORTS, DISJOINT_UNION = OWL + "Ontology", OWL + "imports", OWL + "disjointUnionOf"
DATATYPE, ON_DATATYPE, WITH_RESTRICTIONS, ON_DATA_RANGE = RDFS + "Datatype", OWL + "onDatatype", OWL + "withRestrictions", OWL + "onDataRange"
#: Constraining facets: the field of an expression and the IRI's last part.
FACETS = {
    "length": XSD + "length", "min_length": XSD + "minLength", "max_length": XSD + "maxLength", "pattern": XSD + "pattern",
    "min_inclusive": XSD + "minInclusive", "max_inclusive": XSD + "maxInclusive", "min_exclusive": XSD + "minExclusive",
    "max_exclusive": XSD + "maxExclusive", "total_digits": XSD + "totalDigits", "fraction_digits": XSD + "fractionDigits", "white_space": XSD + "whiteSpace",
}
IMP, BODY, HEAD, VARIABLE, ATOMS = SWRL + "Imp", SWRL + "body", SWRL + "head", SWRL + "Variable", SWRL + "AtomList"
#: Predicates through which a blank node belongs to the construct that refers to it.
CONSTRUCT = (SUBCLASS, EQUIVALENT_CLASS, COMPLEMENT, UNION, INTERSECTION, ONE_OF, SOME, ONLY, VALUE, ON_CLASS, FIRST, REST, MEMBERS, DISTINCT_MEMBERS, CHAIN)

INTEGERS = tuple(XSD + x for x in ("integer", "byte", "short", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "negativeInteger", "nonNegativeInteger", "positiveInteger"))
DECIMALS = (XSD + "decimal", XSD + "double", XSD + "float", OWL + "real")
BOOLEAN, STRING, PLAIN, DATETIME, DATE, TIME = XSD + "boolean", XSD + "string", RDF + "PlainLiteral", XSD + "dateTime", XSD + "date", XSD + "time"
INTEGER, DOUBLE = XSD + "integer", XSD + "double"
