"""Versions, cascade delete, orphan collection, snapshots and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import PUBLIC
from ..plans.store import stored
from . import traverse

ORPHAN_HOPS = 7


def batch_version(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """One version for a whole batch: the largest of all its paths, and one more."""
    return documents.join(paths, "path", "left_semi").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def with_latest(documents: DataFrame, path: str = "path") -> DataFrame:
    """latest, recomputed: the newest version of each path."""
    newest = F.max("version").over(Window.partitionBy("tenant_id", path))
    return documents.withColumn("latest", F.col("version") == newest)


def newer_versions(documents: DataFrame) -> DataFrame:
    """Edges from each version to the next."""
    w = Window.partitionBy("tenant_id", "path").orderBy("version")
    return documents.select("tenant_id", "path", F.lag("version").over(w).alias("older"), F.col("version").alias("newer")).where("older IS NOT NULL")


def select_documents(documents: DataFrame, *, tenant_id: str | None, path: str | None = None, job_id: str | list[str] | None = None, version: int | None = None, user_id: str | list[str] | None = None) -> DataFrame:
    """Seeds of a deletion within one tenant (None: the public one): by exactly one of path and jobs, of a version, of users."""
    if (path is None) == (job_id is None):
        raise ValueError("exactly one of path and job_id")
    several = lambda x: [x] if isinstance(x, str) else list(x)
    df = documents.where(F.col("tenant_id") == (PUBLIC if tenant_id is None else tenant_id))
    df = df.where(F.col("path") == path) if path is not None else df.where(F.col("job_id").isin(several(job_id)))
    df = df if version is None else df.where(F.col("version") == version)
    return df if user_id is None else df.where(F.col("created_by_user_id").isin(several(user_id)))


def with_composed(nav, seeds: DataFrame) -> DataFrame:
    """key of the seeds and of all documents composed of them, to any depth, each once."""
    start = stored(seeds.select(F.col("key").alias("anchor")).distinct())
    below = traverse.closure(start, nav.edges("IS_COMPOSED_OF"))
    return stored(start.select(F.col("anchor").alias("key")).union(below.select(F.col("node").alias("key"))).distinct())


def nodes_below(nav, documents: DataFrame) -> DataFrame:
    """anchor (document key), node of all structure nodes of the documents (a column key), to any depth."""
    return nav.nodes_of_documents(None, documents.select(F.col("key").alias("anchor"))).select("anchor", "node")


def reached(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """node: all that any of the starts (a column node) reaches within so many hops, each once, without the starts as such."""
    one = starts.select(F.lit("").alias("anchor"), "node").distinct()
    step = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    level, found = one.select("node"), []
    while hops is None or len(found) < hops:
        level = level.join(step, "node").select(F.col("next").alias("node")).distinct()
        for seen in found:
            level = level.join(seen, "node", "left_anti")
        level = stored(level)
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.union, found) if found else level


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("node"))


def left_alone(nav, gone: DataFrame, hops: int = ORPHAN_HOPS) -> dict[str, DataFrame]:
    """Instances and entities (uid) that a deletion of results (a column uid) leaves without an owner.

    Candidates are what the results point at, then what each orphan points at, round by round until none is found.
    An instance is an orphan if no result that stays reaches it within so many hops; an entity, if no edge that
    stays leads to it. What hangs from something that stays is never asked about.
    """
    # edges of documents and structure nodes lead to their own tree only
    edges = nav.table("edges")
    edges = edges.where(~F.col("label").isin("Document", "StructureNode")) if "label" in edges.columns else edges
    edges = stored(edges.select("src", "dst").distinct())
    gone = stored(_ids(gone, "uid").distinct())
    keep = nav.table("extraction_result").select(F.col("uid").alias("node")).join(gone, "node", "left_anti")
    safe = stored(reached(keep, edges, hops))
    out = {}
    for name in ("model_instance", "labeled_entity"):
        own = _ids(nav.table(name), "uid")
        lost = stored(gone.where("false"))
        fresh = gone if name == "model_instance" else gone.union(_ids(out["model_instance"], "uid"))
        while True:
            asked = edges.join(fresh, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct().join(own, "node", "left_semi").join(lost, "node", "left_anti")
            if name == "model_instance":
                fresh = asked.join(safe, "node", "left_anti")
            else:
                ended = gone.union(_ids(out["model_instance"], "uid")).union(lost)
                held = edges.join(ended, F.col("src") == F.col("node"), "left_anti").select(F.col("dst").alias("node"))
                fresh = asked.join(held, "node", "left_anti")
            fresh = stored(fresh)
            if fresh.isEmpty():
                break
            lost = stored(lost.union(fresh))
        out[name] = lost.select(F.col("node").alias("uid"))
    return out


def delete_cascade(nav, seeds: DataFrame, documents: DataFrame | None = None, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the seed documents, what is composed of them, all that hangs from their nodes, and orphans.

    documents: what with_composed() gives for the seeds, nodes: what nodes_below() gives for those, if known already.
    Edges go with either of their ends.
    """
    gone = with_composed(nav, seeds) if documents is None else documents
    nodes = nodes_below(nav, gone) if nodes is None else nodes
    nodes = nodes.select("node").distinct()
    out = {"document": nav.table("document").join(gone, "key", "left_anti"), "structure_node": nav.table("structure_node").join(nodes.withColumnRenamed("node", "id"), "id", "left_anti")}
    ended = [_ids(gone, "key"), nodes]
    for name in ("info_unit", "model_decision", "extraction_result"):
        out[name] = nav.table(name).join(nodes, "node", "left_anti")
        ended.append(nav.table(name).join(nodes, "node", "left_semi").select(F.col("uid").alias("node")))
    if hasattr(nav.graph, "model_instance"):
        for name, lost in left_alone(nav, ended[-1].select(F.col("node").alias("uid"))).items():
            out[name] = nav.table(name).join(lost, "uid", "left_anti")
            ended.append(_ids(lost, "uid"))
    ended = stored(reduce(DataFrame.union, ended).distinct())
    out["edges"] = nav.table("edges").join(ended.withColumnRenamed("node", "src"), "src", "left_anti").join(ended.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*nav.table("edges").columns)
    return out


def orphans(instances: DataFrame, results: DataFrame, edges: DataFrame, hops: int = ORPHAN_HOPS) -> DataFrame:
    """uids of instances that no result reaches within so many hops."""
    inside = traverse.of_types(edges, prefix="HAS_")
    return instances.select("uid").join(reached(_ids(results, "uid"), inside, hops).withColumnRenamed("node", "uid"), "uid", "left_anti")


def unreferenced(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without an incoming edge."""
    return entities.select("uid").join(edges.select(F.col("dst").alias("uid")), "uid", "left_anti")


def snapshot(nav, seeds: DataFrame, documents: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The subtrees of the seeds and of what is composed of them as rows of (document, label, key, properties JSON).

    documents and nodes as in delete_cascade, so that what a deletion takes away is what the snapshot holds.
    """
    documents = with_composed(nav, seeds) if documents is None else documents
    nodes = nodes_below(nav, documents) if nodes is None else nodes
    docs = nav.table("document").join(documents, "key", "left_semi")
    row = lambda df, doc, label, key: df.select(F.col(doc).alias("document"), F.lit(label).alias("label"), F.col(key).alias("key"), F.to_json(F.struct(*(c for c in df.columns if c != "anchor"))).alias("properties"))
    out = row(docs, "key", "Document", "key")
    out = out.union(row(nodes.select("anchor", F.col("node").alias("id")).join(nav.table("structure_node"), "id"), "anchor", "StructureNode", "id"))
    for name, label in (("info_unit", "InfoUnit"), ("model_decision", "ModelDecision"), ("extraction_result", "ExtractionResult")):
        out = out.union(row(nodes.select("anchor", "node").join(nav.table(name), "node"), "anchor", label, "uid"))
    if hasattr(nav.graph, "model_instance"):
        # what hangs from the results, once, whatever the number of documents that share it
        results = nav.table("extraction_result").join(nodes.select("node"), "node", "left_semi")
        edges = nav.table("edges")
        edges = edges.where(~F.col("label").isin("Document", "StructureNode")) if "label" in edges.columns else edges
        held = stored(reached(_ids(results, "uid"), edges, ORPHAN_HOPS))
        for name, label in (("model_instance", "ModelInstance"), ("labeled_entity", "LabeledEntity")):
            part = nav.table(name).join(held.withColumnRenamed("node", "uid"), "uid", "left_semi").withColumn("anchor", F.lit(None).cast("string"))
            out = out.union(row(part, "anchor", label, "uid"))
    return out


def snapshot_edges(nav, rows: DataFrame) -> DataFrame:
    """The edges with an end among the rows of a snapshot."""
    keys, edges = stored(rows.select("key").distinct()), nav.table("edges")
    starts = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").select(*edges.columns)
    ends = edges.join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi").join(keys.withColumnRenamed("key", "src"), "src", "left_anti").select(*edges.columns)
    return starts.unionByName(ends)


#: The table and the key of each label of a snapshot.
TABLES = {"Document": ("document", "key"), "StructureNode": ("structure_node", "id"), "InfoUnit": ("info_unit", "uid"), "ModelDecision": ("model_decision", "uid"), "ExtractionResult": ("extraction_result", "uid"), "ModelInstance": ("model_instance", "uid"), "LabeledEntity": ("labeled_entity", "uid")}


def restore_tables(tables: dict[str, DataFrame], rows: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables with the rows of a snapshot that are not there, with all their properties, and its edges between what there is."""
    out, there = dict(tables), []
    for label, (name, key) in TABLES.items():
        if name not in tables:
            continue
        have = tables[name]
        held = rows.where(F.col("label") == label).dropDuplicates(["key"]).select(F.from_json("properties", have.schema).alias("r")).select("r.*")
        out[name] = have.unionByName(held.join(have.select(key), key, "left_anti").select(*have.columns))
        there.append(out[name].select(F.col(key).alias("node")))
    ends = stored(reduce(DataFrame.union, there).distinct())
    same = ["src", "type", "dst"]
    new = edges.join(tables["edges"].select(*same), same, "left_anti").join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out["edges"] = tables["edges"].unionByName(new.select(*tables["edges"].columns))
    return out


def restore(existing: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """Label and key of existing rows and of snapshot rows that are not there yet."""
    missing = snapshot_rows.select("label", "key").distinct().join(existing, ["label", "key"], "left_anti")
    return existing.select("label", "key").union(missing)


def violations(snapshot_rows: DataFrame, tenant_id: str) -> DataFrame:
    """Snapshot rows that must not be restored: another tenant's, of an unknown label, or without a key."""
    tenant = F.get_json_object("properties", "$.tenant_id")
    return snapshot_rows.where((tenant != tenant_id) | ~F.col("label").isin(*TABLES) | F.col("key").isNull())


def progress(events: DataFrame, stages: int, key: str = "user_id", stage: str = "event_type") -> DataFrame:
    """Per run: events, distinct stages done, errors, and the percentage of planned stages."""
    g = events.groupBy(key).agg(F.count("*").alias("events"), F.count_distinct(F.when(F.col(stage) != "error", F.col(stage))).alias("done"), F.count_if(F.col(stage) == "error").alias("errors"))
    return g.withColumn("percent", F.round(100 * F.col("done") / stages, 1))


def sweep(instances: DataFrame, entities: DataFrame, results: DataFrame, edges: DataFrame, hops: int = ORPHAN_HOPS) -> dict[str, DataFrame]:
    """A tenant's instances that no result reaches, and the entities that nothing but those refer to."""
    gone = orphans(instances, results, edges, hops)
    left = edges.join(gone.select(F.col("uid").alias("src")), "src", "left_anti")
    return {"model_instance": gone, "labeled_entity": unreferenced(entities, left)}


def leaves_or_self(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """anchor, leaf: the leaves at any depth below each document, or the document itself where nothing is below it."""
    start = documents.select(F.col("key").alias("anchor"))
    inner = edges.select(F.col("src").alias("node")).distinct()
    below = traverse.closure(start, edges).join(inner, "node", "left_anti").select("anchor", "node")
    return start.join(below, "anchor", "left").select("anchor", F.coalesce("node", "anchor").alias("leaf"))


def freeze(nav, seeds: DataFrame, snapshot_id: str, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The snapshot of the seeds and what is composed of them, and the tables after it.

    All these documents stay as marked stubs, what hangs from them goes. keep names tables that stay whole. The
    snapshot must be written before the tables are replaced.
    """
    documents = with_composed(nav, seeds)
    nodes = nodes_below(nav, documents)
    rows = stored(snapshot(nav, seeds, documents, nodes))
    left = delete_cascade(nav, seeds, documents, nodes)
    # the stubs that stay keep the edges of the tree of documents
    tree = nav.edges("IS_COMPOSED_OF", "HAS_NEWER_VERSION")
    left["edges"] = left["edges"].where(~F.col("type").isin("IS_COMPOSED_OF", "HAS_NEWER_VERSION")).unionByName(tree)
    marked = documents.select("key", F.lit(snapshot_id).alias("snapshot_id"))
    left["document"] = nav.table("document").join(marked, "key", "left")
    for name in keep:
        left[name] = nav.table(name)
    return {"snapshot": rows.withColumn("snapshot_id", F.lit(snapshot_id)), "snapshot_edges": snapshot_edges(nav, rows)} | left


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """document, snapshot_id of the newest snapshot that holds each document. snapshots: document, snapshot_id, stored_at."""
    return snapshots.groupBy("document").agg(F.max_by("snapshot_id", F.struct("stored_at", "snapshot_id")).alias("snapshot_id"))


def restore_plan(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """document, action: recreate what is gone, refill a stub of that snapshot, refuse any other.

    wanted: document, snapshot_id. documents: key, snapshot_id (null: not frozen).
    """
    have = documents.select(F.col("key").alias("document"), F.lit(True).alias("there"), F.col("snapshot_id").alias("frozen"))
    df = wanted.join(have, "document", "left")
    return df.select("document", F.when(F.col("there").isNull(), "recreate").when(F.col("frozen") == F.col("snapshot_id"), "refill").otherwise("refuse").alias("action"))


def restored_edges(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """Existing edges and those of a snapshot that are absent."""
    keys = ["src", "type", "dst"]
    return existing.select(*keys).union(edges.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti"))
