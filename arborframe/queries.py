"""The graph's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import ancestor_paths, edge_type, instance_uid, normalize_key
from .functions.predicates import Op
from .functions.scope import Scope
from .operators.lifecycle import batch_version, delete_cascade, newer_versions, nodes_below, orphans, progress, restore_tables, select_documents, snapshot, snapshot_edges, with_composed, with_latest
from .operators.navigator import Navigator, previous_page
from .operators.transforms import assemble_tree, merge_entities, merge_values, normalization_key, prefix_parents, raw_rows, route_rows
from .oracles import GRAPH, SQL, oracle
from .plans.graph import SampleGraph
from .plans.store import stored
from .record_queries import RECORDS
from .session import prepare
from .sources.text import html_pages, json_items, segments, text_pages
from .write_queries import WRITES

Query = Callable[[SparkSession, str], DataFrame]


def navigator(spark: SparkSession, sf_dir: str, scope: Scope = Scope()) -> Navigator:
    return Navigator(SampleGraph(prepare(spark), sf_dir), scope)


def _nations(n: Navigator) -> DataFrame:
    return n.table("model_instance").where("model_class = 'Nation'").select(F.col("uid").alias("anchor"))


def _regions(n: Navigator) -> DataFrame:
    return n.table("model_instance").where("model_class = 'Region'").select(F.col("uid").alias("anchor"))


def _raw(n: Navigator) -> DataFrame:
    n.graph.source("documents").createOrReplaceTempView("documents")
    return n.execute_raw(n.graph.spark, "SELECT lang, count(*) AS n FROM documents WHERE n_chars > :least GROUP BY lang", {"least": 1000})


#: Queries with arguments; every other one is the method of its name without any.
CALLS: dict[str, Callable[[Navigator], DataFrame]] = {
    "list_root_documents": lambda n: n.list_root_documents().select("path", "version", "is_folder"),
    "get_documents": lambda n: n.get_documents(name_contains="7", is_folder=False, path_prefix="en/", conditions={"job_id": Op("is_not_null")}).select("path", "version", "name"),
    "get_documents_scoped": lambda n: n.scoped(tenant_id="fr", users=["u1", "u2"], jobs=["src0", "src1", "src2"]).get_documents().select("path", "version"),
    "document_exists": lambda n: n.document_exists(n.graph.source("documents").select(F.concat_ws("/", "lang", "source", (F.col("doc_id") + 3).cast("string")).alias("path"))),
    "get_structure_nodes": lambda n: n.get_structure_nodes(roles=["Table", "FreeformBlock"], title_contains="e", conditions={"appearance_order": Op("gte", 2)}),
    "get_structure_nodes_by_ids": lambda n: n.get_structure_nodes_by_ids(n.graph._lines.select(F.col("i").alias("pos"), F.concat("doc", F.lit("::b"), (F.col("i") + 1).cast("string")).alias("id"))),
    "get_child_nodes": lambda n: n.get_child_nodes(depth=2),
    "find_structure_nodes": lambda n: n.find_structure_nodes(title_contains="an", role="FreeformBlock", conditions={"title": Op("regex", "[A-Z].*")}).select("id", "role", "title"),
    "get_nodes_by_theme": lambda n: n.get_nodes_by_theme("tables"),
    "search_info_units": lambda n: n.search_info_units("thanor tisher erstly").select("uid", F.round("score", 6).alias("score")),
    "get_document_model_decisions": lambda n: n.get_document_model_decisions(matched_only=True),
    "get_nodes_by_annotated_model": lambda n: n.get_nodes_by_annotated_model("Report"),
    "get_model_instances_by_class": lambda n: n.get_model_instances_by_class("Order", {"status": "F", "priority": Op("in", ["1-URGENT", "2-HIGH"])}),
    "get_related_model_instances": lambda n: n.get_related_model_instances("FOLLOWED_BY"),
    "get_labeled_entities": lambda n: n.get_labeled_entities(label="Segment", conditions={"normalized_value": Op("ne", "building")}),
    "get_entity_triples": lambda n: n.get_entity_triples("ASIA"),
    "list_model_classes_present": lambda n: n.list_model_classes_present(n.graph.spark.createDataFrame([("Region",), ("Report",), ("Absent",)], "model_class string")),
    "neighbors": lambda n: n.neighbors(_nations(n), 1, ["HAS_NATION", "HAS_CUSTOMER"]).union(n.neighbors(_nations(n), 2, ["HAS_NATION"]).where("depth = 2")),
    "shortest_path": lambda n: n.shortest_path(_regions(n), n.table("model_instance").where("model_class = 'Customer'").select(F.col("uid").alias("node")), edge_types=["HAS_NATION", "HAS_CUSTOMER"]).select("anchor", "node", "hops", F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types")),
    "get_model_instance_subtree": lambda n: n.get_model_instance_subtree(anchors=_regions(n)),
    "subgraph": lambda n: n.subgraph(_regions(n), 2, ["HAS_NATION", "HAS_CUSTOMER"]),
    "get_document_source_text": lambda n: n.get_document_source_text(10),
    "previous_page": lambda n: previous_page(n.pages(10)),
    "execute_raw": _raw,
}


def _query(name: str) -> Query:
    call = CALLS.get(name) or (lambda n: getattr(n, name)())
    return lambda spark, sf_dir: call(navigator(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _query(name) for name in SQL}
ORACLES: dict[str, str] = {name: oracle(name) for name in SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each top-level folder: documents, nodes, units, instances and annotation coverage."""
    n = navigator(spark, sf_dir)
    stats, cover = n.get_document_stats(), n.get_annotation_coverage().select("anchor", "total", "annotated")
    instances = n.count_document_model_instances().groupBy("anchor").agg(F.sum("n").alias("n_instances"))
    df = stats.join(cover, "anchor").join(instances, "anchor", "left").withColumn("folder", F.split("anchor", "::")[0])
    out = df.groupBy("folder").agg(F.count("*").alias("documents"), F.sum("n_nodes").alias("nodes"), F.sum("n_units").alias("units"), F.coalesce(F.sum("n_instances"), F.lit(0)).alias("instances"), F.sum("annotated").alias("a"), F.sum("total").alias("t"))
    return out.select("folder", "documents", "nodes", "units", "instances", F.round(F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(0.0), 6).alias("coverage"))


QUERIES["folder_overview"] = flagship
ORACLES["folder_overview"] = GRAPH + """, c AS (SELECT b.anchor, count(*) AS nodes, count(u.uid) AS units, count(d.uid) AS annotated FROM below b LEFT JOIN unit u ON u.node = b.node LEFT JOIN decision d ON d.node = b.node GROUP BY b.anchor),
    i AS (SELECT b.anchor, count(DISTINCT x.node) AS n FROM below b JOIN nodeinst x ON x.anchor = b.node GROUP BY b.anchor)
    SELECT split_part(c.anchor, '::', 1) AS folder, count(*) AS documents, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(units) AS BIGINT) AS units, CAST(coalesce(sum(i.n), 0) AS BIGINT) AS instances, round(sum(annotated) / sum(nodes), 6) AS coverage
    FROM c LEFT JOIN i USING (anchor) GROUP BY 1"""


# ---- transforms and lifecycle ------------------------------------------------------------------------------


def _q(make: Callable[[SparkSession, str, Navigator], DataFrame], sql: str, graph: bool = False):
    return lambda spark, d: make(spark, d, navigator(spark, d)), (GRAPH + sql if graph else sql)


_PARTS = "array(p_name, p_type, concat(' ', p_type, ' '), split(p_type, ' ')[0], p_brand)"

MORE = {
    "uids": _q(
        lambda s, d, n: n.graph.source("nation").select("n_nationkey", instance_uid("Country", {"country_code": normalize_key(F.col("n_name"), ascii_only=True)}).alias("uid")),
        "SELECT n_nationkey, substr(sha256('2:mi||7:Country||6:tenant||10:__public__||12:country_code||' || length(v) || ':' || v), 1, 16) AS uid FROM (SELECT n_nationkey, lower(trim(n_name)) AS v FROM nation)",
    ),
    "ancestor_paths": _q(
        lambda s, d, n: n.table("document").select(F.explode(ancestor_paths(F.col("path"))).alias("path")).distinct(),
        "SELECT DISTINCT path FROM (SELECT lang AS path FROM documents UNION ALL SELECT lang || '/' || source FROM documents)",
    ),
    "edge_types": _q(
        lambda s, d, n: n.graph.source("part").select("p_type").distinct().select("p_type", edge_type(F.col("p_type"), ascii_only=True).alias("edge_type")),
        "SELECT DISTINCT p_type, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) AS edge_type FROM part",
    ),
    "merge_values": _q(
        lambda s, d, n: n.graph.source("part").select("p_partkey", F.array_join(merge_values(F.expr(_PARTS)), "; ").alias("merged")),
        "SELECT p_partkey, p_name || CASE WHEN contains(lower(p_name), lower(p_type)) THEN '' ELSE '; ' || p_type END || '; ' || p_brand AS merged FROM part",
    ),
    "route_rows": _q(
        lambda s, d, n: route_rows(n.graph.source("customer").select("c_custkey", "c_name", "c_mktsegment", F.lower("c_mktsegment").alias("segment_2")), "c_custkey", s.createDataFrame([("c_name", "Customer", "name", "high"), ("c_mktsegment", "Customer", "segment", "high"), ("segment_2", "Customer", "segment", "medium")], "column_name string, target string, field string, confidence string")),
        "SELECT c_custkey, 'Customer' AS target, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Customer', 'segment', c_mktsegment FROM customer",
    ),
    "raw_rows": _q(
        lambda s, d, n: raw_rows(n.graph.source("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("2nd key")), "s_suppkey"),
        "SELECT s_suppkey, 'HAS_S_NAME' AS type, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'HAS_COL_2ND_KEY', CAST(s_nationkey AS VARCHAR) FROM supplier",
    ),
    "normalization_keys": _q(
        lambda s, d, n: n.graph.source("part").select(normalization_key("Part", ["p_type", "p_brand"]).alias("unique_key")).groupBy("unique_key").agg(F.count("*").alias("n")),
        "SELECT 'Part:' || md5('p_brand=' || lower(p_brand) || '|p_type=' || lower(p_type)) AS unique_key, count(*) AS n FROM part GROUP BY 1",
    ),
    "prefix_parents": _q(
        lambda s, d, n: prefix_parents(n.graph.source("part").select("p_brand", F.explode(F.array(F.replace("p_type", F.lit(" "), F.lit("_")), F.split("p_type", " ")[0])).alias("id")), "p_brand", "id"),
        "SELECT i.p_brand, i.id, max_by(j.id, length(j.id)) AS parent FROM (SELECT DISTINCT p_brand, unnest([replace(p_type, ' ', '_'), split_part(p_type, ' ', 1)]) AS id FROM part) i LEFT JOIN (SELECT DISTINCT p_brand, unnest([replace(p_type, ' ', '_'), split_part(p_type, ' ', 1)]) AS id FROM part) j ON i.p_brand = j.p_brand AND starts_with(i.id, j.id || '_') GROUP BY ALL",
    ),
    "assemble_tree": _q(
        lambda s, d, n: assemble_tree(n.graph.source("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_orphan")), n.graph.source("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1).otherwise(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey") - 5)).cast("string").alias("parent"), F.lit(1).alias("seq"))),
        """, w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 ELSE o_orderkey - 5 END AS p FROM orders),
           k AS (SELECT w.id, CASE WHEN o.o_orderkey IS NOT NULL THEN p END AS p FROM w LEFT JOIN orders o ON o.o_orderkey = p)
           SELECT CAST(a.id AS VARCHAR) AS id, CAST(CASE WHEN b.p = a.id OR a.p = a.id THEN NULL ELSE a.p END AS VARCHAR) AS parent FROM k a LEFT JOIN k b ON b.id = a.p""",
        graph=True,
    ),
    "merge_entities": _q(
        lambda s, d, n: merge_entities(n.graph.source("orders").select(F.col("o_orderpriority").alias("uid"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("job_id"))),
        "SELECT o_orderpriority AS uid, min_by(o_orderpriority || o_orderkey, o_orderkey) AS value, list_sort(list(DISTINCT o_orderstatus)) AS job_ids FROM orders GROUP BY 1",
    ),
    "batch_version": _q(
        lambda s, d, n: batch_version(n.table("document"), n.table("document").where("job_id = 'src1'").select("path")),
        "SELECT max(version) + 1 AS version FROM document WHERE path IN (SELECT path FROM document WHERE job_id = 'src1')",
        graph=True,
    ),
    "with_latest": _q(
        lambda s, d, n: with_latest(n.table("document").drop("latest")).select("key", "latest"),
        "SELECT key, latest FROM document",
        graph=True,
    ),
    "newer_versions": _q(
        lambda s, d, n: newer_versions(n.table("document")),
        "SELECT tenant_id, path, 1 AS older, 2 AS newer FROM leaf WHERE newest = 2",
        graph=True,
    ),
    "delete_cascade": _q(
        lambda s, d, n: _digests(delete_cascade(n, select_documents(n.table("document"), tenant_id="en", job_id="src0"))),
        """, gone AS (SELECT key FROM document WHERE job_id = 'src0' AND tenant_id = 'en'), gn AS (SELECT id FROM node WHERE doc IN (SELECT key FROM gone)), gx AS (SELECT uid FROM result WHERE node IN (SELECT id FROM gn)),
           safe AS (SELECT DISTINCT node FROM contained WHERE anchor NOT IN (SELECT uid FROM gx)),
           gi AS (SELECT uid FROM instance WHERE uid IN (SELECT node FROM contained WHERE anchor IN (SELECT uid FROM gx)) AND uid NOT IN (SELECT node FROM safe)),
           ge(uid) AS (SELECT uid FROM entity WHERE uid IN (SELECT dst FROM edge WHERE type = 'REFERENCES' AND src IN (SELECT uid FROM gi)) AND uid NOT IN (SELECT dst FROM edge WHERE (type = 'REFERENCES' AND src NOT IN (SELECT uid FROM gi)) OR type = 'REQUESTS')),
           allgone AS (SELECT key AS k FROM gone UNION ALL SELECT id FROM gn UNION ALL SELECT uid FROM unit WHERE node IN (SELECT id FROM gn) UNION ALL SELECT uid FROM decision WHERE node IN (SELECT id FROM gn) UNION ALL SELECT uid FROM gx UNION ALL SELECT uid FROM gi UNION ALL SELECT uid FROM ge)
           SELECT label, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(k), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (
           SELECT 'document' AS label, key AS k FROM document UNION ALL SELECT 'structure_node', id FROM node UNION ALL SELECT 'info_unit', uid FROM unit UNION ALL SELECT 'model_decision', uid FROM decision
           UNION ALL SELECT 'extraction_result', uid FROM result UNION ALL SELECT 'model_instance', uid FROM instance UNION ALL SELECT 'labeled_entity', uid FROM entity) WHERE k NOT IN (SELECT k FROM allgone) GROUP BY label
           UNION ALL SELECT 'edges', count(*), CAST(sum(CAST('0x' || substr(md5(src || type || dst), 1, 8) AS BIGINT)) AS BIGINT) FROM edge WHERE src NOT IN (SELECT k FROM allgone) AND dst NOT IN (SELECT k FROM allgone)""",
        graph=True,
    ),
    "orphans": _q(
        lambda s, d, n: orphans(n.table("model_instance"), n.table("extraction_result").where("model_class = 'Toxic'"), n.edges("HAS_REGION", "HAS_NATION", "HAS_CUSTOMER", "HAS_ORDER")),
        "SELECT uid FROM instance WHERE uid NOT IN (SELECT c.node FROM contained c JOIN result r ON r.uid = c.anchor WHERE r.model_class = 'Toxic')",
        graph=True,
    ),
    "snapshot_round_trip": _q(
        lambda s, d, n: _round_trip(n),
        """SELECT label, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(k), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (
           SELECT 'document' AS label, key || path || version AS k FROM document UNION ALL SELECT 'structure_node', id || role || title FROM node UNION ALL SELECT 'info_unit', uid || description FROM unit UNION ALL SELECT 'model_decision', uid || confidence FROM decision
           UNION ALL SELECT 'extraction_result', uid || model_class FROM result UNION ALL SELECT 'model_instance', uid || model_class FROM instance UNION ALL SELECT 'labeled_entity', uid || value FROM entity UNION ALL SELECT 'edges', src || type || dst FROM edge) GROUP BY label""",
        graph=True,
    ),
    "progress": _q(
        lambda s, d, n: progress(n.graph.source("events"), 4),
        "SELECT user_id, count(*) AS events, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS done, count(*) FILTER (event_type = 'error') AS errors, round(100 * count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) / 4, 1) AS percent FROM events GROUP BY user_id",
    ),
    "text_pages": _q(
        lambda s, d, n: text_pages(n.graph.source("documents"), "doc_id", "text", 7).select("doc_id", "page", F.length("markdown").alias("size")),
        "SELECT doc_id, CAST(i // 7 AS INTEGER) AS page, length(string_agg(s[i + 1], chr(10) ORDER BY i)) AS size FROM (SELECT *, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) GROUP BY doc_id, i // 7",
    ),
    "media_segments": _q(
        lambda s, d, n: n.graph.source("orders").select("o_orderkey", F.explode(segments((F.col("o_orderkey") * 37 % 20000).cast("long"), 3000, 1000)).alias("s")).select("o_orderkey", "s.start_ms", "s.end_ms"),
        """SELECT o_orderkey, CASE WHEN i > 0 AND i = n - 1 AND dur - i * 3000 < 1000 THEN (dur - 1000) // 1000 * 1000 ELSE i * 3000 END AS start_ms,
               CASE WHEN i = n - 1 THEN dur WHEN i = n - 2 AND dur - (i + 1) * 3000 < 1000 THEN (dur - 1000) // 1000 * 1000 ELSE (i + 1) * 3000 END AS end_ms
           FROM (SELECT o_orderkey, dur, n, unnest(range(0, n)) AS i FROM (SELECT o_orderkey, o_orderkey * 37 % 20000 AS dur, greatest(1, CAST(ceil((o_orderkey * 37 % 20000) / 3000) AS BIGINT)) AS n FROM orders))""",
    ),
    "json_items": _q(
        lambda s, d, n: json_items(n.graph.source("events").select("event_id", F.concat(F.lit('{"items": ['), "props", F.lit(']}')).alias("body")), "event_id", "body", "$.items", {"k": "$.k"}),
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    ),
    "html_pages": _q(
        lambda s, d, n: html_pages(n.graph.source("pages"), "page_id", "html").groupBy("page_id").agg(F.count_if(F.col("markdown").startswith("# ")).alias("headings")),
        "SELECT page_id, CAST((length(html) - length(replace(html, '<h1', ''))) // 3 AS BIGINT) AS headings FROM pages",
    ),
}


#: What tells a row of each table apart.
_KEYS = {"document": ("key",), "structure_node": ("id",), "info_unit": ("uid",), "model_decision": ("uid",), "extraction_result": ("uid",), "model_instance": ("uid",), "labeled_entity": ("uid",), "edges": ("src", "type", "dst")}
_CONTENTS = {"document": ("key", "path", "version"), "structure_node": ("id", "role", "title"), "info_unit": ("uid", "description"), "model_decision": ("uid", "confidence"), "extraction_result": ("uid", "model_class"), "model_instance": ("uid", "model_class"), "labeled_entity": ("uid", "value"), "edges": ("src", "type", "dst")}


def _digests(tables: dict[str, DataFrame], columns: dict[str, tuple[str, ...]] = _KEYS) -> DataFrame:
    """label, n, digest (a sum over rows, whatever their order) of each table."""
    text = lambda k: F.concat(*(F.col(c).cast("string") for c in columns[k]))
    parts = [tables[k].select(F.lit(k).alias("label"), F.conv(F.substring(F.md5(text(k)), 1, 8), 16, 10).cast("long").alias("h")) for k in columns]
    return reduce(DataFrame.union, parts).groupBy("label").agg(F.count("*").alias("n"), F.sum("h").alias("digest"))


def _round_trip(n: Navigator) -> DataFrame:
    """What there is per label, by its contents, after a job's documents were exported, deleted and restored."""
    seeds = select_documents(n.table("document"), tenant_id="en", job_id="src0")
    # both steps start from the same documents and nodes, found once
    documents = with_composed(n, seeds)
    nodes = stored(nodes_below(n, documents))
    rows = stored(snapshot(n, seeds, documents, nodes))
    edges = stored(snapshot_edges(n, rows))
    left = delete_cascade(n, seeds, documents, nodes)
    return _digests(restore_tables(left, rows, edges), _CONTENTS)


MORE |= {k: _q(lambda s, d, n, make=make: make(n), sql, graph) for k, (make, sql, graph) in (RECORDS | WRITES).items()}
QUERIES |= {k: v[0] for k, v in MORE.items()}
ORACLES |= {k: v[1] for k, v in MORE.items()}
