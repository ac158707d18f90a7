"""Writing sheets as graph rows, and deleting them: a table node, a node and a unit per row, their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import column_edge_type, normalize_key, structure_id, tenant_key, uid
from ..plans.store import stored
from .lifecycle import reached

#: What a result without a model is called, where it comes from, how much of a cell it keeps.
RAW_CLASS, RAW_SOURCE, RAW_LENGTH = "GenericTabularRow", "tabular_raw", 500
INSTANCE_HOPS = 10


def table_id(document: Column, sheet_index: Column) -> Column:
    """A table's id: its document's key and the sheet's number from 1."""
    return structure_id(document, F.concat(F.lit("table_"), (sheet_index + 1).cast("string")))


def cells_markdown(headers: Column, cells: Column) -> Column:
    """A row as a table of one line, from arrays of headers and cells; nulls are empty."""
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | ", ""), F.lit(" |"))
    return F.concat_ws("\n", line(headers), line(F.transform(headers, lambda _: F.lit("---"))), line(cells))


def write_sheets(documents: DataFrame, sheets: DataFrame, rows: DataFrame, ascii_only: bool = False) -> dict[str, DataFrame]:
    """The graph rows of sheets; the plan covers all sheets of all documents.

    documents: key, tenant_id, created_by_user_id, job_id. sheets: doc (a document's key), sheet_index (from 0),
    sheet_name, headers (an array), theme, matched_model (null: none), page_id (null: not stored), each sheet once.
    rows: doc, sheet_index, row_index (from 0), cells (an array of texts as wide as headers).

    A sheet without rows still has its table; rows without a sheet make nothing; sheets whose document is unknown
    come back in ``missing``, and they and their rows make nothing else. Without a model a row's cells that hold something
    become entities, one per tenant and normalised value, which the row's result points at by column.
    """
    at = ["doc", "sheet_index"]
    owner = documents.select(F.col("key").alias("doc"), "tenant_id", "created_by_user_id", "job_id")
    known = sheets.join(owner, "doc").withColumn("table", table_id(F.col("doc"), F.col("sheet_index")))
    count = rows.groupBy(*at).agg(F.count("*").alias("row_count"))
    own = ("tenant_id", "created_by_user_id", "job_id")
    pages = F.filter(F.array("page_id"), lambda p: F.coalesce(p != "", F.lit(False))).alias("source_page_ids")
    theme = F.coalesce("theme", F.lit("default")).alias("theme")
    number = lambda c: (F.col(c) + 1).cast("int").alias("appearance_order")
    none = lambda kind: F.lit(None).cast(kind)

    tables = known.join(count, at, "left").select(F.col("table").alias("id"), "doc", none("string").alias("parent"), F.lit("table").alias("role"), F.col("sheet_name").alias("title"), number("sheet_index"), theme, F.size("headers").alias("column_count"), F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), none("long").alias("row_index"), pages, *own)
    decided = known.withColumn("decision", uid(F.lit("model_decision"), F.col("table"), F.coalesce("matched_model", F.lit("null"))))
    full = rows.join(decided, at).withColumn("node", F.concat("table", F.lit("/row_"), (F.col("row_index") + 1).cast("string")))
    full = full.withColumn("unit", uid(F.col("node"), F.lit("row_data"))).withColumn("result", uid(F.lit("tabular_extraction"), F.col("node"), F.coalesce("matched_model", F.lit("raw"))))
    nodes = full.select(F.col("node").alias("id"), "doc", F.col("table").alias("parent"), F.lit("row").alias("role"), none("string").alias("title"), number("row_index"), theme, none("int").alias("column_count"), none("long").alias("row_count"), F.col("row_index").cast("long").alias("row_index"), pages, *own)
    units = full.select(F.col("unit").alias("uid"), "node", F.lit("Row data").alias("title"), cells_markdown(F.col("headers"), F.col("cells")).alias("description"), F.lit(0).alias("order"), *own)
    results = full.select(F.col("result").alias("uid"), "node", F.coalesce("matched_model", F.lit(RAW_CLASS)).alias("model_class"), F.when(F.col("matched_model").isNull(), RAW_SOURCE).alias("source"), *own)

    cell = F.explode(F.arrays_zip(F.col("headers").alias("header"), F.col("cells").alias("value"))).alias("c")
    raw = full.where("matched_model IS NULL").select("tenant_id", "result", cell).where("c.header <> '' AND c.value <> ''")
    raw = raw.select("tenant_id", "result", column_edge_type(F.col("c.header")).alias("type"), F.substring("c.value", 1, RAW_LENGTH).alias("value"))
    raw = raw.withColumn("norm", normalize_key(F.col("value"), ascii_only)).where("norm <> ''").withColumn("entity", uid(F.lit("entity"), tenant_key(F.col("tenant_id")), F.col("norm")))
    # the smallest spelling, so that the result does not hang on the order of rows
    entities = raw.groupBy("tenant_id", F.col("entity").alias("uid")).agg(F.min("value").alias("value"))

    link = lambda df, src, kind, dst: df.select("tenant_id", F.col(src).alias("src"), kind.alias("type"), F.col(dst).alias("dst"))
    edges = [
        link(known, "doc", F.lit("HAS_STRUCTURE"), "table"),
        link(decided, "table", F.lit("HAS_DECISION"), "decision"),
        link(full, "table", F.lit("HAS_CHILD"), "node"),
        link(full, "node", F.lit("HAS_INFO_UNIT"), "unit"),
        link(full, "node", F.lit("HAS_DECISION"), "decision"),
        link(full, "node", F.lit("HAS_EXTRACTION"), "result"),
        link(raw, "result", F.col("type"), "entity").distinct(),
    ]
    return {
        "structure_node": tables.union(nodes),
        "info_unit": units,
        "model_decision": decided.select(F.col("decision").alias("uid"), F.col("table").alias("node"), "matched_model", *own),
        "extraction_result": results,
        "entity": entities,
        "edges": reduce(DataFrame.union, edges),
        "missing": sheets.join(owner, "doc", "left_anti"),
    }


def delete_tables(tables: dict[str, DataFrame], ids: DataFrame, hops: int = INSTANCE_HOPS) -> dict[str, DataFrame]:
    """The graph's tables without some table nodes (ids: a column id) and what hangs from them and from their rows.

    Units, decisions and results of the tables and of their rows go, and the instances that a row's result reaches
    within so many hops, but not what raw results point at: entities are shared, and stay. Edges go with either end.
    """
    edges = tables["edges"]
    gone = ids.select(F.col("id").alias("node")).distinct()
    rows = edges.where("type = 'HAS_CHILD'").join(gone.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    nodes = stored(gone.union(rows).distinct())
    out = {"structure_node": tables["structure_node"].join(nodes.withColumnRenamed("node", "id"), "id", "left_anti")}
    ended = [nodes]
    for name in ("info_unit", "model_decision", "extraction_result"):
        out[name] = tables[name].join(nodes, "node", "left_anti")
        ended.append(tables[name].join(nodes, "node", "left_semi").select(F.col("uid").alias("node")))
    if "model_instance" in tables:
        results = tables["extraction_result"].where(F.col("source").isNull() | (F.col("source") != RAW_SOURCE)).join(rows, "node", "left_semi")
        lost = reached(results.select(F.col("uid").alias("node")), edges, hops).withColumnRenamed("node", "uid")
        out["model_instance"] = tables["model_instance"].join(lost, "uid", "left_anti")
        ended.append(tables["model_instance"].join(lost, "uid", "left_semi").select(F.col("uid").alias("node")))
    end = stored(reduce(DataFrame.union, ended).distinct())
    out["edges"] = edges.join(end.withColumnRenamed("node", "src"), "src", "left_anti").join(end.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
    return out
