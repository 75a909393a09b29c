"""DuckDB oracles over the base tables: plain SQL, independent of the lifted quads."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "pat_obj_scan": r"""
SELECT c_custkey AS s, c_nationkey AS o FROM customer
""",
    "pat_data_exact": r"""
SELECT c_custkey AS s FROM customer WHERE c_mktsegment='BUILDING'
""",
    "pat_predicate_counts": r"""
SELECT 'mktsegment' AS p, count(*) AS n FROM customer UNION ALL SELECT 'orderstatus', count(*) FROM orders UNION ALL SELECT 'retailprice', count(*) FROM part
""",
    "pat_inverse_union": r"""
SELECT o_custkey AS s, o_orderkey AS o FROM orders
""",
    "pat_punned": r"""
SELECT DISTINCT s_nationkey AS s FROM supplier INTERSECT SELECT DISTINCT c_nationkey FROM customer
""",
    "search_type": r"""
SELECT p_partkey AS s FROM part WHERE p_type='ECONOMY'
""",
    "search_subclass_of": r"""
SELECT DISTINCT p_type||'/'||p_brand AS s FROM part WHERE p_type='ECONOMY' UNION SELECT 'ECONOMY'
""",
    "search_is_a": r"""
SELECT 'ECONOMY' AS s UNION SELECT p_type||'/'||p_brand FROM part WHERE p_type='ECONOMY' UNION SELECT 'part/'||p_partkey FROM part WHERE p_type='ECONOMY'
""",
    "search_subproperty": r"""
SELECT 'orders' AS src, o_orderkey AS s, o_orderdate AS d FROM orders UNION ALL SELECT 'lineitem', l_orderkey, l_shipdate FROM lineitem
""",
    "search_or_class": r"""
SELECT p_partkey AS s FROM part WHERE p_type IN ('ECONOMY','PROMO')
""",
    "search_iri_glob": r"""
SELECT c_custkey AS s FROM customer WHERE c_name GLOB '*#00000012*'
""",
    "search_iri_nocase": r"""
SELECT c_custkey AS s FROM customer WHERE c_name ILIKE '%CUSTOMER#00000001%'
""",
    "search_text_glob": r"""
SELECT p_partkey AS s FROM part WHERE p_name GLOB 'red*'
""",
    "search_text_nocase": r"""
SELECT p_partkey AS s FROM part WHERE p_name ILIKE '%WIDGET%'
""",
    "search_nums": r"""
SELECT p_partkey AS s FROM part WHERE p_size>10 AND p_size<=20
""",
    "search_all_values": r"""
SELECT l_suppkey AS s FROM lineitem WHERE l_partkey IN (10,11) GROUP BY l_suppkey HAVING count(DISTINCT l_partkey)=2
""",
    "search_wildcard": r"""
SELECT DISTINCT d.doc_id AS s FROM documents d SEMI JOIN labels l ON d.doc_id=l.doc_id
""",
    "search_none": r"""
SELECT d.doc_id AS s FROM documents d ANTI JOIN labels l ON d.doc_id=l.doc_id
""",
    "search_nested": r"""
SELECT o_orderkey AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey=2))
""",
    "search_nested_union": r"""
SELECT o_orderkey AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal<0)
""",
    "search_union": r"""
SELECT p_partkey AS s FROM part WHERE p_size<5 UNION SELECT p_partkey FROM part WHERE p_type='PROMO'
""",
    "search_intersect": r"""
SELECT p_partkey AS s FROM part WHERE p_size<5 INTERSECT SELECT p_partkey FROM part WHERE p_type='PROMO'
""",
    "search_count": r"""
SELECT count(*) AS n FROM part WHERE p_type='PROMO' AND p_size<25
""",
    "search_flagship": r"""
SELECT c_custkey AS s FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=2 AND c_acctbal>5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT' AND o_orderstatus='P')
""",
    "fts_and": r"""
SELECT doc_id AS s FROM documents WHERE list_contains(string_split_regex(lower(strip_accents(text)),'[^a-z0-9]+'),'the') AND list_contains(string_split_regex(lower(strip_accents(text)),'[^a-z0-9]+'),'and')
""",
    "fts_prefix": r"""
SELECT doc_id AS s FROM documents WHERE len(list_filter(string_split_regex(lower(strip_accents(text)),'[^a-z0-9]+'), lambda x: starts_with(x,'eau')))>0
""",
    "fts_lang": r"""
SELECT doc_id AS s FROM documents WHERE lang='fr' AND list_contains(string_split_regex(lower(strip_accents(text)),'[^a-z0-9]+'),'la')
""",
    "fts_bm25": r"""
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(strip_accents(text)),'[^a-z0-9]+')) AS tok FROM documents), t2 AS (SELECT * FROM t WHERE tok<>''), dl AS (SELECT doc_id, count(*) AS l FROM t2 GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM dl)*1.0/(SELECT count(*) FROM documents) AS avgdl), tf AS (SELECT doc_id, count(*) AS f FROM t2 WHERE tok='ouen' GROUP BY 1), df AS (SELECT count(*) AS d FROM tf) SELECT tf.doc_id AS s, round(-greatest(ln((n-d+0.5)/(d+0.5)),1e-6)*f*2.2/(f+1.2*(0.25+0.75*l/avgdl)),6) AS bm25 FROM tf JOIN dl USING(doc_id), st, df ORDER BY bm25, s LIMIT 20
""",
    "closure_ancestors": r"""
WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey//2 AS o FROM customer WHERE c_custkey>0), t AS (SELECT s,o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o=e.s) SELECT s,o FROM t
""",
    "closure_descendants": r"""
WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey//2 AS o FROM customer WHERE c_custkey>0), t AS (SELECT s,1 AS depth FROM e WHERE o=3 UNION ALL SELECT e.s, depth+1 FROM t JOIN e ON e.o=t.s) SELECT s, depth FROM t
""",
    "closure_cyclic": r"""
WITH RECURSIVE e AS (SELECT c_custkey AS s, (c_custkey//60)*60+(c_custkey*7+1)%60 AS o FROM customer), t AS (SELECT s,o FROM e UNION SELECT t.s, e.o FROM t JOIN e ON t.o=e.s) SELECT s,o FROM t
""",
    "closure_equivalence": r"""
SELECT doc_id AS s, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents
""",
    "closure_multi_property": r"""
SELECT c_custkey AS s, 'nation/'||c_nationkey AS o FROM customer UNION ALL SELECT c_custkey, 'region/'||n_regionkey FROM customer JOIN nation ON c_nationkey=n_nationkey
""",
    "rdf_list_order": r"""
SELECT l_orderkey AS lst, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey AS item FROM lineitem
""",
    "root_classes": r"""
SELECT DISTINCT p_type AS s FROM part
""",
    "most_specific": r"""
SELECT p_partkey AS s, p_type||'/'||p_brand AS cls FROM part
""",
    "lca": r"""
WITH RECURSIVE a AS (SELECT k AS start, k AS x FROM (VALUES (70),(71),(145)) v(k) UNION SELECT start, x//2 FROM a WHERE x>1), c AS (SELECT x FROM a GROUP BY x HAVING count(DISTINCT start)=3) SELECT max(x) AS s FROM c
""",
    "complete_families": r"""
SELECT p_type AS parent FROM (SELECT DISTINCT p_type,p_brand FROM part) GROUP BY 1 HAVING count(*)=25
""",
    "term_mapping": r"""
SELECT DISTINCT a.doc_id AS src, b.source AS dst FROM documents a JOIN documents b ON a.text=b.text AND a.source<>b.source
""",
    "reified_annotation": r"""
SELECT l_orderkey AS s, l_partkey AS o, l_quantity AS qty FROM lineitem
""",
    "property_chain": r"""
SELECT DISTINCT l_suppkey AS s, o_custkey AS o FROM lineitem JOIN orders ON l_orderkey=o_orderkey
""",
    "restr_some": r"""
SELECT DISTINCT l_orderkey AS s FROM lineitem JOIN part ON l_partkey=p_partkey WHERE p_type='PROMO'
""",
    "restr_only": r"""
SELECT o_orderkey AS s FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag<>'N')
""",
    "restr_min": r"""
SELECT l_orderkey AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey)>=6
""",
    "restr_exactly": r"""
SELECT o_orderkey AS s FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1 HAVING count(DISTINCT l_partkey)=0
""",
    "class_expr": r"""
SELECT p_partkey AS s FROM part WHERE (p_type='PROMO' OR p_size<5) AND NOT (p_brand IN ('Brand#1','Brand#2'))
""",
    "facets": r"""
SELECT p_partkey AS s FROM part WHERE length(p_name)<=9 AND regexp_full_match(p_name,'[a-z]+ [a-z]+') AND p_retailprice>=950 AND p_retailprice<1200
""",
    "close_world": r"""
SELECT l_orderkey AS s, string_agg(k,',' ORDER BY k) AS fillers FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS k FROM lineitem) GROUP BY 1
""",
    "infer_domain_range": r"""
SELECT DISTINCT 'Orderer' AS cls, o_custkey AS s FROM orders UNION SELECT DISTINCT 'Supplied', l_partkey FROM lineitem
""",
    "infer_new_relations": r"""
SELECT DISTINCT o_custkey AS s, l_suppkey AS o FROM orders JOIN lineitem ON o_orderkey=l_orderkey
""",
    "violations": r"""
SELECT doc_id AS s FROM labels WHERE quality=1 AND toxic=1
""",
    "swrl_arith": r"""
SELECT l_orderkey AS s, l_linenumber AS ln, round(l_extendedprice/l_quantity,4) AS unit_price FROM lineitem
""",
    "swrl_matches": r"""
SELECT p_partkey AS s FROM part WHERE regexp_full_match(p_name,'re.*')
""",
    "sparql_bgp": r"""
SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_acctbal>9000
""",
    "sparql_optional": r"""
SELECT d.doc_id AS doc, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id
""",
    "sparql_group": r"""
SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey GROUP BY 1
""",
    "sparql_minus": r"""
SELECT DISTINCT source AS source, doc_id AS doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)
""",
    "mut_delete": r"""
SELECT l_orderkey AS s, l_partkey AS o, l_suppkey AS c FROM lineitem WHERE NOT (l_returnflag='R')
""",
    "mut_refactor": r"""
SELECT n_nationkey AS s, replace(n_name,'NATION_','COUNTRY_') AS iri FROM nation
""",
    "observe_collapsed": r"""
SELECT date_trunc('hour', ts) AS scan, user_id AS s, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS preds FROM events GROUP BY 1,2
""",
    "instances_ordered": r"""
SELECT p_partkey AS s, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM part WHERE p_type='SMALL'
""",
    "next_numbered_iri": r"""
SELECT max(regexp_extract(c_name,'([0-9]+)$',1)::BIGINT)+1 AS n FROM customer
""",
    "export_ntriples": r"""
SELECT '<http://t/nation/'||n_nationkey||'> <http://t/in_region> <http://t/region/'||n_regionkey||'> .' AS line FROM nation
""",
    "rrf_fill_down": r"""
SELECT conv_id AS s, turn, last_value(CASE WHEN role='user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prev FROM conversations
""",
    "rrf_preferred_label": r"""
SELECT source AS concept, doc_id AS label FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r=1
""",
    "interval_parent": r"""
SELECT p_partkey AS s, (p_partkey//100)*100 AS parent FROM part
""",
    "parent_votes": r"""
SELECT user_id AS s, event_type AS p, count(*) AS votes FROM events GROUP BY 1,2
""",
}
