"""Queries of the catalogue, of stored sources and of writing records, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.keys import normalize_key
from .operators.lifecycle import TABLES, freeze, leaves_or_self, newest_snapshot, restore, restore_plan, restored_edges, select_documents, sweep
from .operators.records import instance_rows, instantiate, keyed_links, sibling_links, source_values, upsert, with_shells, write_triples
from .operators.transforms import active_branch, annotation_context, best_theme, compact_parents, merge_siblings, namespaced, renumbered
from .plans.catalogue import SAMPLE
from .sources.media import find_in_transcript, select_images

_FIELDS = ", ".join(f"('{m.name}', '{m.theme}', '{f}', '{t}')" for m in SAMPLE.declared.values() for f, t in m.fields.items())
_RELATIONS = "(VALUES " + ", ".join(f"('{s}', '{t}', '{d}')" for m in SAMPLE.declared.values() for s, t, d in [(m.name, "HAS_" + f.upper(), x) for f, x in m.references()] + [(m.name, "REFERENCES", x) for x in m.labels.values()]) + ") r(source, type, target)"
_MI = "substr(sha256('2:mi||' || length('{c}') || ':{c}||6:tenant||10:__public__||3:key||' || length({k}) || ':' || {k}), 1, 16)"
_ENTITY = "substr(sha256('6:entity||10:__public__||' || length(lower(trim({v}))) || ':' || lower(trim({v}))), 1, 16)"


def _record(n):
    """Customers with their orders as nested records; a list per customer, in the order of keys."""
    o = n.graph.source("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    c = n.graph.source("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").cast("string").alias("uid"), F.struct("c_name", F.struct("c_nationkey").alias("place"), "orders").alias("record"))


def _followers(n):
    lines = n.graph.source("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return keyed_links(lines.select(F.col("l_orderkey").cast("string").alias("uid"), "parts"), "uid", "parts", "Part", "key", {}, "CONTAINS")


def _triples(n):
    p = n.graph.source("part")
    return write_triples(p.select(F.col("p_brand").alias("subject"), F.lit("is made as").alias("predicate"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("object"), F.col("p_partkey").alias("seq")))


def _restored(n):
    e = n.edges("FOLLOWED_BY").select("src", "type", "dst")
    return restored_edges(e.where("src < dst"), e).groupBy("type").agg(F.count("*").alias("n"))


def _frozen(n):
    out = freeze(n, select_documents(n.table("document"), tenant_id="en", job_id="src0"), "s1")
    return out["document"].groupBy("snapshot_id").agg(F.count("*").alias("documents")).withColumn("snapshot_id", F.coalesce("snapshot_id", F.lit("none")))


def _frozen_folder(n):
    """What there is per label after a folder was frozen and restored, and how many documents the freeze marked."""
    out = freeze(n, n.table("document").where("is_folder AND path = 'en'"), "s1")
    left = [out[t].select(F.lit(label).alias("label"), F.col(key).alias("key")) for label, (t, key) in TABLES.items() if t != "document"]
    stubs = out["document"].where("snapshot_id = 's1'").select(F.lit("stub").alias("label"), "key")
    rest = out["document"].where("snapshot_id IS NULL").select(F.lit("Document").alias("label"), "key")
    return restore(reduce(DataFrame.union, [rest, *left]), out["snapshot"]).union(stubs).groupBy("label").agg(F.count("*").alias("n"))


def _first(n):
    """Tenant, path, newest version and key of the document with the smallest number, for point lookups."""
    r = n.graph.leaf.select("doc_id", "tenant_id", "path", "newest").orderBy("doc_id").limit(1).first()
    return r.tenant_id, r.path, r.newest, f"{r.tenant_id}::{r.path}::{r.newest}"


_FIRST = ", first AS (SELECT *, tenant_id || '::' || path || '::' || newest AS key FROM leaf WHERE doc_id = (SELECT min(doc_id) FROM leaf)) "


def _entity_uid(n):
    return n.table("labeled_entity").agg(F.min("uid")).first()[0]


def _image(n):
    r = n.get_document_images().orderBy("anchor", "page_index", "image_index").limit(1).first()
    return n.get_page_image(r.anchor, r.page_index, r.image_index).select("doc", "page_index", "image_index", F.sha2("content", 256).alias("sha256"))


_EVENT_SNAPSHOTS = "user_id AS document, event_type AS snapshot_id, ts AS stored_at"

#: Name: what makes the result from a navigator, SQL, and whether the SQL needs the graph's tables.
RECORDS = {
    "get_one_document": (lambda n: n.get_one_document(_first(n)[1], _first(n)[2]).select("key", "name", "latest"), _FIRST + "SELECT key, CAST(doc_id AS VARCHAR) AS name, true AS latest FROM first", True),
    "get_version_chain": (lambda n: n.get_version_chain(), "SELECT tenant_id, path, version, latest FROM document", True),
    "get_structure_node": (lambda n: n.get_structure_node(_first(n)[3] + "::s0").select("id", "role", "title"), _FIRST + "SELECT id, role, title FROM node WHERE id = (SELECT key || '::s0' FROM first)", True),
    "get_info_unit": (lambda n: n.get_info_unit(_first(n)[3] + "::u0").select("uid", "node", "title"), _FIRST + "SELECT uid, node, title FROM unit WHERE uid = (SELECT key || '::u0' FROM first)", True),
    "get_model_instance": (lambda n: n.get_model_instance("Nation:0").select("uid", "model_class", F.col("props")["name"].alias("name")), "SELECT uid, model_class, name FROM instance WHERE uid = 'Nation:0'", True),
    "get_labeled_entity": (lambda n: n.get_labeled_entity(_entity_uid(n)).select("uid", "label", "value"), "SELECT uid, label, value FROM entity WHERE uid = (SELECT min(uid) FROM entity)", True),
    "get_nodes_referencing_entity": (
        lambda n: n.get_nodes_referencing_entity(),
        "SELECT DISTINCT e.dst AS entity, i.anchor AS owner FROM nodeinst i JOIN edge e ON e.src = i.node AND e.type = 'REFERENCES'",
        True,
    ),
    "get_page_image": (_image, "SELECT doc, CAST(i // 20 AS INTEGER) AS page_index, i AS image_index, sha256(line) AS sha256 FROM line WHERE contains(line, '|') ORDER BY doc, i LIMIT 1", True),
    "get_entity_relationships": (lambda n: n.get_entity_relationships(), "SELECT src AS anchor, type, dst AS other, 'out' AS direction FROM edge WHERE type = 'REQUESTS' UNION ALL SELECT dst, type, src, 'in' FROM edge WHERE type = 'REQUESTS'", True),
    "get_related_entities": (lambda n: n.get_related_entities("REQUESTS"), "SELECT e.src AS anchor, d.uid, d.label, d.value FROM edge e JOIN entity d ON d.uid = e.dst WHERE e.type = 'REQUESTS'", True),
    "get_triples": (
        lambda n: n.get_triples(),
        """, hit AS (SELECT m.result, m.entity, e.type, o.entity AS other FROM mention m JOIN edge e ON e.src = m.entity AND e.type = 'REQUESTS' JOIN mention o ON o.result = m.result AND o.entity = e.dst)
           SELECT m.node AS anchor, s.value AS subject, h.type AS predicate, o.value AS object FROM mention m LEFT JOIN hit h ON h.result = m.result AND h.entity = m.entity JOIN entity s ON s.uid = m.entity LEFT JOIN entity o ON o.uid = h.other""",
        True,
    ),
    "get_model_instance_by_key": (
        lambda n: n.scoped(tenant_id="fr").get_model_instance_by_key(n.graph.source("orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("key")).distinct(), "Customer", ["key"]),
        "SELECT DISTINCT ' ' || o_custkey AS key, 'Customer:' || o_custkey AS uid FROM ord WHERE tenant_id = 'fr'",
        True,
    ),
    "list_catalog_models": (lambda n: n.list_catalog_models(include_fields=True), f"SELECT * FROM (VALUES {_FIELDS}) c(model_class, theme, field, type)", False),
    "get_catalog_graph": (lambda n: n.get_catalog_graph()["relations"], f"SELECT * FROM {_RELATIONS}", False),
    "get_catalog_graph_in_use": (
        lambda n: n.get_catalog_graph_in_use("model_instances")["relations"],
        f", kept AS (SELECT model_class AS x FROM instance UNION SELECT model_class FROM result UNION SELECT label FROM entity) SELECT source, type, target FROM {_RELATIONS} WHERE source IN (SELECT x FROM kept) AND target IN (SELECT x FROM kept)",
        True,
    ),
    "list_node_labels": (
        lambda n: n.list_node_labels(),
        "SELECT 'Document' AS label FROM document UNION SELECT 'StructureNode' FROM node UNION SELECT 'InfoUnit' FROM unit UNION SELECT 'ModelDecision' FROM decision UNION SELECT 'ExtractionResult' FROM result UNION SELECT 'ModelInstance' FROM instance UNION SELECT 'LabeledEntity' FROM entity UNION SELECT role FROM node UNION SELECT label FROM entity",
        True,
    ),
    "get_structure_nodes_source_pages": (
        lambda n: n.get_structure_nodes_source_pages()["nodes"].select("node", F.array_join("found", ",").alias("found"), F.size("not_found").cast("long").alias("missing")),
        "SELECT id AS node, doc || '::p' || (CASE WHEN role = 'Section' THEN appearance_order WHEN role = 'Subsection' THEN CAST(split_part(regexp_extract(id, '::s([0-9.]+)$', 1), '.', 1) AS BIGINT) ELSE appearance_order // 20 END) AS found, 0 AS missing FROM node",
        True,
    ),
    "get_info_unit_source_text": (
        lambda n: n.get_info_unit_source_text().select("anchor", "page_index", F.length("markdown").alias("size")),
        ", p AS (SELECT doc, i // 20 AS page_index, length(string_agg(line, chr(10) ORDER BY i)) AS size FROM line GROUP BY doc, i // 20) SELECT u.uid AS anchor, CAST(p.page_index AS INTEGER) AS page_index, p.size FROM unit u JOIN line l ON l.doc || '::u' || l.i = u.uid JOIN p ON p.doc = l.doc AND p.page_index = l.i // 20",
        True,
    ),
    "get_document_original": (lambda n: n.get_document_original().select("anchor", "size", "sha256"), "SELECT tenant_id || '::' || path || '::' || newest AS anchor, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM leaf", True),
    "get_document_images": (lambda n: n.get_document_images(kind="figure"), "SELECT doc AS anchor, CAST(i // 20 AS INTEGER) AS page_index, i AS image_index, 'figure' AS kind, CAST(strlen(line) AS BIGINT) AS size FROM line WHERE contains(line, '|') AND length(line) > 40", True),
    "write_instances": (
        lambda n: instance_rows(_record(n), "Customer", "record")["nodes"].groupBy("model_class").agg(F.count("*").alias("n"), F.sum(F.size("props")).alias("props")),
        "SELECT 'Customer' AS model_class, count(*) AS n, count(*) AS props FROM customer UNION ALL SELECT 'Customer.place', count(*), count(*) FROM customer UNION ALL SELECT 'Customer.orders', count(*), 2 * count(*) FROM orders JOIN customer ON c_custkey = o_custkey",
        False,
    ),
    "keyed_links": (
        lambda n: _followers(n)["edges"],
        f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS src, 'CONTAINS' AS type, {_MI.format(c='Part', k='CAST(l_partkey AS VARCHAR)')} AS dst FROM lineitem",
        False,
    ),
    "shell_instances": (
        lambda n: with_shells(n.graph.source("part").where("p_size > 25").select(_part_uid().alias("uid"), F.lit("Part").alias("model_class"), F.create_map(F.lit("name"), F.col("p_name")).alias("props")), _followers(n)["shells"]).groupBy(F.map_contains_key("props", F.lit("name")).alias("real")).agg(F.count("*").alias("n")),
        "SELECT p_partkey IS NOT NULL AS real, count(*) AS n FROM (SELECT p_partkey FROM part WHERE p_size > 25) FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey GROUP BY 1",
        False,
    ),
    "sibling_links": (
        lambda n: sibling_links(n.graph.source("part").select("p_partkey", F.explode(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("entity")), F.struct(F.lit("type").alias("field"), F.col("p_type").alias("entity")))).alias("r")).select(F.col("p_partkey").alias("instance"), "r.*"), n.graph.spark.createDataFrame([("brand", "MAKES", "type")], "field string, type string, to_field string")),
        "SELECT DISTINCT p_brand AS src, 'MAKES' AS type, p_type AS dst FROM part",
        False,
    ),
    "write_triples": (
        lambda n: _triples(n)["edges"],
        f"SELECT {_ENTITY.format(v='p_brand')} AS src, 'IS_MADE_AS' AS type, {_ENTITY.format(v='p_type')} AS dst, 'is made as' AS predicate FROM part WHERE p_size > 5 GROUP BY 1, 3",
        False,
    ),
    "triple_entities": (lambda n: _triples(n)["entities"], f"SELECT DISTINCT {_ENTITY.format(v='v')} AS uid, v AS value FROM (SELECT unnest([p_brand, p_type]) AS v FROM part WHERE p_size > 5)", False),
    "upsert": (
        lambda n: upsert(n.graph.source("nation").select("n_nationkey", "n_name"), n.graph.source("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")).union(n.graph.spark.createDataFrame([(99, "NEW")], "n_nationkey int, n_name string")), ["n_nationkey"]),
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'",
        False,
    ),
    "instantiate_rows": (
        lambda n: instantiate(n.graph.source("orders").select("o_orderkey", "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("rank")), {"rank": "int", "o_orderpriority": "int"}).select("o_orderkey", F.col("record.rank").alias("rank"), F.col("record.o_orderpriority").alias("priority")),
        "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, TRY_CAST(o_orderpriority AS INTEGER) AS priority FROM orders",
        False,
    ),
    "source_values": (
        lambda n: source_values(n.graph.source("supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise("x").alias("note"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("codes")), "s_suppkey", ["s_name", "note", "codes"]),
        "SELECT s_suppkey, 's_name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'note', 'x' FROM supplier WHERE s_suppkey % 2 <> 0 UNION ALL SELECT s_suppkey, 'codes', '[1]' FROM supplier WHERE s_suppkey % 3 = 0",
        False,
    ),
    "merge_siblings": (
        lambda n: merge_siblings(n.graph.source("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("id"), F.col("l_shipdate").cast("string").alias("title"), F.array("l_linenumber").alias("pages"), F.when(F.col("l_linestatus") == "O", "open").otherwise("general").alias("theme"), F.struct("l_linenumber", "l_shipdate").alias("seq")), ["parent", "id"], "seq").select("parent", "id", "title", "theme", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")),
        "SELECT l_orderkey AS parent, l_returnflag AS id, min_by(CAST(l_shipdate AS VARCHAR), (l_linenumber, l_shipdate)) AS title, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'open' ELSE 'general' END AS theme, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS pages FROM lineitem GROUP BY 1, 2",
        False,
    ),
    "compact_parents": (
        lambda n: compact_parents(n.graph.source("part").select("p_brand", F.replace("p_type", F.lit(" "), F.lit("_")).alias("id"), F.lit("Block").alias("role"), F.lit("nowhere").alias("parent_id")).union(n.graph.source("part").select("p_brand", F.split("p_type", " ")[0], F.lit("Section"), F.lit(None).cast("string"))).distinct(), "p_brand"),
        "WITH t AS (SELECT DISTINCT p_brand, unnest([replace(p_type, ' ', '_'), split_part(p_type, ' ', 1)]) AS id, unnest(['Block', 'Section']) AS role FROM part) SELECT i.p_brand, i.id, CASE WHEN i.role <> 'Section' THEN (SELECT max_by(j.id, length(j.id)) FROM (SELECT DISTINCT p_brand, id FROM t) j WHERE j.p_brand = i.p_brand AND starts_with(i.id, j.id || '_')) END AS parent FROM t i",
        False,
    ),
    "active_branch": (
        lambda n: active_branch(n.table("structure_node").withColumn("at", F.struct((F.col("role") == "Section"), "appearance_order")).where("role <> 'Table' AND role <> 'FreeformBlock'").select("doc", "id", "parent", F.col("id").alias("at")), "doc", "at", "parent"),
        ", s AS (SELECT * FROM node WHERE role IN ('Section', 'Subsection')), last AS (SELECT doc, max(id) AS id FROM s GROUP BY doc) SELECT doc, id, 0 AS level FROM last UNION ALL SELECT l.doc, s.parent, 1 FROM last l JOIN s ON s.id = l.id WHERE s.parent IS NOT NULL",
        True,
    ),
    "namespaced_order": (
        lambda n: renumbered(n.graph.source("lineitem").select("l_orderkey", "l_linenumber", namespaced(F.col("l_linenumber"), F.col("l_orderkey").cast("string")).alias("id")), ["l_orderkey"], "l_linenumber").select("id", "appearance_order"),
        "SELECT 'page-' || l_linenumber || '::' || l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS appearance_order FROM lineitem",
        False,
    ),
    "best_theme": (
        lambda n: best_theme(n.graph.source("part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("/")).alias("detected")), "detected", n.graph.source("part").where("p_size > 25").select(F.split("p_type", " ")[0].alias("theme"))).select("p_partkey", "theme"),
        "SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN (SELECT split_part(p_type, ' ', 1) FROM part WHERE p_size > 25) THEN split_part(p_type, ' ', 1) ELSE 'default' END AS theme FROM part",
        False,
    ),
    "annotation_context": (
        lambda n: annotation_context(n.table("structure_node").where("role = 'Subsection'").select("id", "title"), n.table("info_unit"), n.edges("HAS_CHILD").select("src", F.col("dst").alias("id")).join(n.table("structure_node").select("id", "role", "title", "appearance_order"), "id")).select("id", "title", F.array_join("children", "|").alias("children"), F.size("units").cast("long").alias("units")),
        "SELECT s.id, s.title, string_agg(c.title, '|' ORDER BY c.appearance_order) AS children, 0 AS units FROM node s JOIN node c ON c.parent = s.id WHERE s.role = 'Subsection' GROUP BY 1, 2",
        True,
    ),
    "orphan_sweep": (
        lambda n: sweep(n.table("model_instance"), n.table("labeled_entity"), n.table("extraction_result").where("model_class = 'Toxic'"), n.edges())["labeled_entity"].select("uid"),
        ", safe AS (SELECT DISTINCT c.node FROM contained c JOIN result r ON r.uid = c.anchor WHERE r.model_class = 'Toxic') SELECT uid FROM entity WHERE uid NOT IN (SELECT dst FROM edge WHERE type = 'REQUESTS') AND uid NOT IN (SELECT dst FROM edge WHERE type = 'REFERENCES' AND src IN (SELECT node FROM safe))",
        True,
    ),
    "resolve_leaves": (
        lambda n: leaves_or_self(n.table("document"), n.edges("IS_COMPOSED_OF")),
        ", up AS (SELECT tenant_id || '::' || tenant_id || '::1' AS a, tenant_id || '::' || folder || '::1' AS b, tenant_id || '::' || path || '::' || v AS leaf FROM (SELECT *, unnest(range(1, newest + 1)) AS v FROM leaf)) SELECT a AS anchor, leaf FROM up UNION ALL SELECT b, leaf FROM up UNION ALL SELECT leaf, leaf FROM up",
        True,
    ),
    "freeze": (lambda n: _frozen(n), "SELECT CASE WHEN job_id = 'src0' AND tenant_id = 'en' THEN 's1' ELSE 'none' END AS snapshot_id, count(*) AS documents FROM document GROUP BY 1", True),
    "freeze_folder": (
        lambda n: _frozen_folder(n),
        "SELECT 'Document' AS label, count(*) AS n FROM document UNION ALL SELECT 'StructureNode', count(*) FROM node UNION ALL SELECT 'InfoUnit', count(*) FROM unit UNION ALL SELECT 'ModelDecision', count(*) FROM decision UNION ALL SELECT 'ExtractionResult', count(*) FROM result UNION ALL SELECT 'ModelInstance', count(*) FROM instance UNION ALL SELECT 'LabeledEntity', count(*) FROM entity UNION ALL SELECT 'stub', count(*) FROM document WHERE tenant_id = 'en'",
        True,
    ),
    "newest_snapshot": (lambda n: newest_snapshot(n.graph.source("events").selectExpr(*_EVENT_SNAPSHOTS.split(", "))), "SELECT user_id AS document, max_by(event_type, (ts, event_type)) AS snapshot_id FROM events GROUP BY 1", False),
    "restore_plan": (
        lambda n: restore_plan(n.graph.source("orders").select(F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("snapshot_id")), n.graph.source("orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "O", "F").alias("snapshot_id"))),
        "SELECT o_orderkey AS document, CASE WHEN NOT coalesce(o_orderpriority < '3', false) THEN 'recreate' WHEN o_orderstatus = 'F' THEN 'refill' ELSE 'refuse' END AS action FROM orders",
        False,
    ),
    "restored_edges": (lambda n: _restored(n), "SELECT 'FOLLOWED_BY' AS type, count(*) AS n FROM ord WHERE next IS NOT NULL", True),
    "select_images": (
        lambda n: select_images(n.graph.source("lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("width"), F.lit(40).alias("height"), F.encode(F.col("l_shipdate").cast("string"), "UTF-8").alias("content")), "l_orderkey", 20, 1).select("l_orderkey", "page", "index"),
        "WITH f AS (SELECT * FROM lineitem WHERE least(l_quantity, 40) >= 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber % 2, l_linenumber) = 1) SELECT l_orderkey, l_linenumber % 2 AS page, l_linenumber AS index FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY CAST(l_quantity AS BIGINT) * 40 DESC, l_linenumber) = 1",
        False,
    ),
    "find_in_transcript": (
        lambda n: n.graph.source("documents").select("doc_id", F.size(find_in_transcript(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.struct(t.alias("text"))), "The  A")).cast("long").alias("n")),
        "SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(regexp_replace(lower(x), '\\s+', ' ', 'g'), 'the a'))) AS BIGINT) AS n FROM documents",
        False,
    ),
}


def _part_uid():
    from .functions.keys import instance_uid

    return instance_uid("Part", {"key": normalize_key(F.col("p_partkey").cast("string"), ascii_only=True)})

