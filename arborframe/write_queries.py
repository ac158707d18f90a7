"""Queries of writing and deleting sheets, of targets and manual decisions, and of orphans' parents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.annotation import annotation_targets, extraction_targets, manual_decisions
from .operators.navigator import Navigator
from .operators.sheets import delete_tables, table_id, write_sheets
from .operators.transforms import orphan_parents
from .plans.graph import Graph
from .plans.store import stored


def _sheets(n):
    """Parts as sheets: a document for each type but one, which is unknown, a sheet for each brand; some without a model."""
    part = n.graph.source("part").select("p_partkey", F.concat(F.lit("__public__::"), "p_type", F.lit("::1")).alias("doc"), F.substring("p_brand", 7, 9).cast("int").alias("sheet_index"), "p_type", "p_brand", F.array(F.coalesce("p_name", F.lit("")), F.col("p_size").cast("string")).alias("cells"))
    documents = part.where("p_type <> 'ECONOMY'").select(F.col("doc").alias("key"), F.lit("__public__").alias("tenant_id"), F.lit("u").alias("created_by_user_id"), F.lit("j").alias("job_id")).distinct()
    sheets = part.select("doc", "sheet_index", F.col("p_brand").alias("sheet_name")).distinct().select("*", F.array(F.lit("name"), F.lit("size")).alias("headers"), F.lit("parts").alias("theme"), F.when(F.col("sheet_index") < 10, "Part").alias("matched_model"), F.lit("").alias("page_id"))
    rows = part.select("doc", "sheet_index", (F.row_number().over(Window.partitionBy("doc", "sheet_index").orderBy("p_partkey")) - 1).alias("row_index"), "cells")
    return write_sheets(documents, sheets, rows, ascii_only=True)


_HASH = "substr(sha256({0}), 1, 16)"
_NODE = "length(n) || ':' || n"
_PARTS = f"""WITH s AS (SELECT *, '__public__::' || p_type || '::1' AS doc, CAST(substr(p_brand, 7) AS INTEGER) AS b, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS i,
        p_brand AS title FROM part WHERE p_type <> 'ECONOMY'),
    r AS (SELECT *, t || '/row_' || (i + 1) AS n FROM (SELECT *, doc || '::table_' || (b + 1) AS t FROM s)),
    u AS (SELECT *, {_HASH.format(_NODE + " || '||8:row_data'")} AS unit, {_HASH.format("'18:tabular_extraction||' || " + _NODE + " || '||' || CASE WHEN b < 10 THEN '4:Part' ELSE '3:raw' END")} AS result,
        {_HASH.format("'14:model_decision||' || length(t) || ':' || t || '||' || CASE WHEN b < 10 THEN '4:Part' ELSE '4:null' END")} AS decision FROM r),
    c AS (SELECT result, b, 'HAS_NAME' AS type, p_name AS v FROM u WHERE b >= 10 UNION ALL SELECT result, b, 'HAS_SIZE', CAST(p_size AS VARCHAR) FROM u WHERE b >= 10),
    k AS (SELECT *, {_HASH.format("'6:entity||10:__public__||' || length(lower(trim(v))) || ':' || lower(trim(v))")} AS entity FROM c WHERE trim(v) <> ''),
    e AS (SELECT DISTINCT doc AS src, 'HAS_STRUCTURE' AS type, t AS dst, b FROM u UNION ALL SELECT DISTINCT t, 'HAS_DECISION', decision, b FROM u UNION ALL SELECT t, 'HAS_CHILD', n, b FROM u
        UNION ALL SELECT n, 'HAS_INFO_UNIT', unit, b FROM u UNION ALL SELECT n, 'HAS_DECISION', decision, b FROM u UNION ALL SELECT n, 'HAS_EXTRACTION', result, b FROM u UNION ALL SELECT DISTINCT result, type, entity, b FROM k) """


def _without_model(n):
    """The edges that stay when the tables that have a model are deleted."""
    made = _sheets(n)
    made = {t: stored(made[t]) for t in ("structure_node", "info_unit", "model_decision", "extraction_result", "edges")}
    ids = made["model_decision"].where("matched_model IS NOT NULL").select(F.col("node").alias("id"))
    return delete_tables(made, ids)["edges"]


def _missing(n):
    return _sheets(n)["missing"].select(table_id(F.col("doc"), F.col("sheet_index")).alias("id"))


def _english(n) -> DataFrame:
    return n.table("document").where("tenant_id = 'en'").select(F.col("key").alias("anchor"))


def _by_hand(n):
    """A navigator over the graph after the English documents' nodes were decided by hand."""
    tables = {t: n.table(t) for t in ("document", "structure_node", "info_unit")}
    return Navigator(Graph(tables | manual_decisions(n, "Report", _english(n))))


def _orphans(n):
    lines = n.graph.source("lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("chunk"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("id"), F.when(F.col("l_returnflag") == "N", "Section").otherwise("Table").alias("role")).distinct()
    # a chunk's sizes sum to one, so that every chunk is a batch
    lines = lines.withColumn("size", F.when(F.row_number().over(Window.partitionBy("group", "chunk").orderBy("id")) == 1, 1).otherwise(0))

    def first_section(asked, pool):
        return asked.join(pool.where("role = 'Section'").groupBy("group").agg(F.min("id").alias("parent")), "group").select("group", "id", "parent")

    return orphan_parents(lines, first_section, 1)


#: As in record_queries: what makes the result, SQL, and whether the SQL needs the graph's tables.
WRITES = {
    "write_sheets": (
        lambda n: _sheets(n)["structure_node"].select("id", "parent", "role", "title", "appearance_order", "row_count", "row_index"),
        _PARTS + "SELECT t AS id, NULL AS parent, 'table' AS role, title, CAST(b + 1 AS INTEGER) AS appearance_order, count(*) AS row_count, NULL AS row_index FROM u GROUP BY t, title, b UNION ALL SELECT n, t, 'row', NULL, CAST(i + 1 AS INTEGER), NULL, i FROM u",
        False,
    ),
    "write_sheet_units": (lambda n: _sheets(n)["info_unit"].select("uid", "node", "description"), _PARTS + "SELECT unit AS uid, n AS node, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(p_name, '') || ' | ' || coalesce(CAST(p_size AS VARCHAR), '') || ' |' AS description FROM u", False),
    "write_sheet_results": (lambda n: _sheets(n)["extraction_result"].select("uid", "node", "model_class", "source"), _PARTS + "SELECT result AS uid, n AS node, CASE WHEN b < 10 THEN 'Part' ELSE 'GenericTabularRow' END AS model_class, CASE WHEN b >= 10 THEN 'tabular_raw' END AS source FROM u", False),
    "write_sheet_entities": (lambda n: _sheets(n)["entity"].select("uid", "value"), _PARTS + "SELECT entity AS uid, min(v) AS value FROM k GROUP BY 1", False),
    "write_sheet_edges": (lambda n: _sheets(n)["edges"].select("src", "type", "dst"), _PARTS + "SELECT src, type, dst FROM e", False),
    "sheets_without_document": (_missing, "SELECT DISTINCT '__public__::ECONOMY::1::table_' || (CAST(substr(p_brand, 7) AS INTEGER) + 1) AS id FROM part WHERE p_type = 'ECONOMY'", False),
    "delete_tables": (lambda n: _without_model(n).select("src", "type", "dst"), _PARTS + "SELECT src, type, dst FROM e WHERE b >= 10", False),
    "annotation_targets": (
        lambda n: annotation_targets(n),
        "SELECT doc AS anchor, id AS node, title, role, CAST(appearance_order AS INTEGER) AS appearance_order, theme FROM node WHERE id IN (SELECT node FROM unit)",
        True,
    ),
    "unannotated_targets": (lambda n: annotation_targets(_by_hand(n), only_unannotated=True).select("anchor", "node"), "SELECT doc AS anchor, id AS node FROM node WHERE tenant_id <> 'en' AND id IN (SELECT node FROM unit)", True),
    "manual_decisions": (
        lambda n: manual_decisions(n, "Report", _english(n))["model_decision"].select("uid", "node", "matched_model", "confidence"),
        "SELECT uid, node, matched_model, confidence FROM decision UNION ALL SELECT DISTINCT substr(sha256('manual_model_decision||' || node || '||Report'), 1, 16), node, 'Report', 'high' FROM unit WHERE tenant_id = 'en'",
        True,
    ),
    "extraction_targets": (
        lambda n: extraction_targets(_by_hand(n)).select("anchor", "node", "title", "matched_model", F.array_join(F.transform("units", lambda u: u["description"]), "|").alias("units")),
        "SELECT o.doc AS anchor, o.id AS node, o.title, 'Report' AS matched_model, string_agg(u.description, '|' ORDER BY u.ord) AS units FROM node o JOIN unit u ON u.node = o.id WHERE o.tenant_id = 'en' GROUP BY 1, 2, 3",
        True,
    ),
    "orphan_parents": (
        _orphans,
        """WITH n AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY c) AS b FROM (SELECT DISTINCT l_orderkey AS g, l_linenumber AS c, l_linenumber || l_returnflag AS id, l_returnflag = 'N' AS top FROM lineitem)),
           p AS (SELECT x.g, x.b, min(s.id) AS parent FROM (SELECT DISTINCT g, b FROM n) x JOIN n s ON s.g = x.g AND s.b IN (x.b - 1, x.b) AND s.top GROUP BY 1, 2)
           SELECT o.g AS "group", o.id, (SELECT min_by(p.parent, p.b) FROM p WHERE p.g = o.g AND p.b >= o.b) AS parent FROM n o WHERE NOT o.top""",
        False,
    ),
}
