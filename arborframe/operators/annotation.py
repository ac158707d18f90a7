"""Which nodes are to be annotated or extracted from, and decisions made by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import legacy_uid
from .lifecycle import reached
from .sheets import INSTANCE_HOPS, RAW_SOURCE


def _nodes(nav, anchors) -> DataFrame:
    """anchor, node of the latest documents' structure nodes, at any depth, that have a unit."""
    latest = nav.table("document").where("latest").select(F.col("key").alias("anchor"))
    latest = latest if anchors is None else nav._anchored(latest, anchors)
    below = nav.nodes_of_documents(None, latest).select("anchor", "node").distinct()
    return below.join(nav.table("info_unit").select("node"), "node", "left_semi")


def annotation_targets(nav, only_unannotated: bool = False, anchors=None) -> DataFrame:
    """anchor, node, title, role, appearance_order, theme of the latest documents' nodes that have a unit."""
    targets = _nodes(nav, anchors)
    if only_unannotated:
        targets = targets.join(nav.table("model_decision").select("node"), "node", "left_anti")
    n = nav.table("structure_node").select(F.col("id").alias("node"), "title", "role", "appearance_order", F.coalesce("theme", F.lit("default")).alias("theme"))
    return targets.join(n, "node").select("anchor", "node", "title", "role", "appearance_order", "theme")


def extraction_targets(nav, only_unextracted: bool = False, anchors=None, complementary: DataFrame | None = None, supplementary: DataFrame | None = None) -> DataFrame:
    """anchor, node, title, matched_model, units and what else was decided, of the latest documents' decided nodes.

    units: structs (order, uid, title, description) in that order. complementary: node, model_class, coverage_note;
    supplementary: node, field_name, field_type, description, required; each becomes an array, empty without any. A null model
    stands for triples. Nodes that hold a raw result are left out; only_unextracted leaves out those with any.
    """
    results = nav.table("extraction_result")
    if not only_unextracted:
        results = results.where(F.col("source") == RAW_SOURCE) if "source" in results.columns else results.where("false")
    targets = _nodes(nav, anchors).join(results.select("node"), "node", "left_anti")
    units = nav.table("info_unit").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("order", "uid", "title", "description"))).alias("units"))
    n = nav.table("structure_node").select(F.col("id").alias("node"), "title", "appearance_order")
    out = targets.join(nav.table("model_decision").select("node", "matched_model"), "node").join(n, "node").join(units, "node")
    for name, more in (("complementary", complementary), ("supplementary", supplementary)):
        if more is not None:
            item = F.struct(*(c for c in more.columns if c != "node"))
            kept = more.groupBy("node").agg(F.array_sort(F.collect_set(item)).alias(name))
            out = out.join(kept, "node", "left").withColumn(name, F.coalesce(name, F.array().cast(kept.schema[name].dataType)))
    return out


def manual_decisions(nav, model_class: str, anchors=None, hops: int = INSTANCE_HOPS) -> dict[str, DataFrame]:
    """Decisions, results, instances and edges after every node with a unit of some documents got a model by hand.

    What those nodes had goes: decisions, results, and instances that these results reach within so many hops, whether
    or not another result reaches them too. New decisions have legacy uids and the source ``manual``.
    """
    nodes = _nodes(nav, anchors).select("node").distinct()
    made = nodes.join(nav.table("structure_node").select(F.col("id").alias("node"), "tenant_id"), "node")
    made = made.select("tenant_id", legacy_uid(F.lit("manual_model_decision"), F.col("node"), F.lit(model_class)).alias("uid"), "node", F.lit(model_class).alias("matched_model"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("proposed_model"), F.lit("manual").alias("source"))
    old, results = nav.table("model_decision"), nav.table("extraction_result")
    stale = results.join(nodes, "node", "left_semi").select(F.col("uid").alias("node"))
    lost = reached(stale, nav.table("edges"), hops).withColumnRenamed("node", "uid")
    instances = nav.table("model_instance")
    ended = reduce(DataFrame.union, [stale, old.join(nodes, "node", "left_semi").select("uid"), instances.join(lost, "uid", "left_semi").select("uid")]).distinct()
    edges = nav.table("edges").join(ended.withColumnRenamed("node", "src"), "src", "left_anti").join(ended.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return {
        "model_decision": old.join(nodes, "node", "left_anti").unionByName(made, allowMissingColumns=True),
        "extraction_result": results.join(nodes, "node", "left_anti"),
        "model_instance": instances.join(lost, "uid", "left_anti"),
        "edges": edges.select("tenant_id", "src", "type", "dst").union(made.select("tenant_id", "node", F.lit("HAS_DECISION"), "uid")),
    }
