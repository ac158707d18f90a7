"""The read query API over the graph's tables.

Every method returns a DataFrame. One that starts from a document, node or instance has a column ``anchor`` (a
document's key, a node's id, an instance's uid): it answers for all anchors in one plan, or for those given.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import instance_uid, normalize_key
from ..functions.predicates import where
from ..functions.scope import Scope
from ..plans.store import few, stored
from . import traverse

GENERIC_DEPTH, CONTAINMENT_DEPTH = 10, 12
#: Of owners and of what they hold: the rows of a block at least, and the blocks of a set while these hold no more
#: than BLOCK rows. A row is shuffled once for each block of the other side, so that few blocks cost little disk.
OWNERS, ITEMS, BLOCK = (256, 4), (1024, 64), 16384
_WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace|load|set|reset|cache|uncache|refresh|add|use|copy|call)\b", re.I)


def ordered(df: DataFrame, *by: str, limit: int | None = None, skip: int | None = None) -> DataFrame:
    """Nulls last when ascending (a name), first when descending (a name after a minus)."""
    df = df.orderBy(*(F.desc_nulls_first(b[1:]) if b.startswith("-") else F.asc_nulls_last(b) for b in by))
    if skip is not None:
        df = df.offset(skip)
    return df.limit(limit) if limit is not None else df


def _blocks(df: DataFrame, least: int, parts: int, number: str, rows: str) -> DataFrame:
    """held, number, rows: the rows of each set (a column held) in about so many arrays, of about least to BLOCK rows."""
    row = F.struct(*(c for c in df.columns if c != "held"))
    sizes = df.groupBy("held").agg(F.count("*").alias("_n"))
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(least), F.ceil(F.col("_n") / parts)))
    at = F.pmod(F.xxhash64(row), F.ceil(F.col("_n") / most)).alias(number)
    return df.join(sizes, "held").groupBy("held", at).agg(F.collect_list(row).alias(rows))


def _pairs(owners: DataFrame, found: DataFrame) -> DataFrame:
    """held, _o, _owners, _i, _items: each block of a set's owners with each block of its rows, dealt out."""
    pairs = _blocks(owners, *OWNERS, "_o", "_owners").join(_blocks(found, *ITEMS, "_i", "_items"), "held")
    return pairs.repartition(int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions")), "held", "_o", "_i")


def product(owners: DataFrame, found: DataFrame) -> DataFrame:
    """anchor and found's columns: each owner (anchor, held) with every row of its set (held, ...).

    Where neither repeats a row, no row of the product does. What is shuffled are pairs of blocks, so that a set with
    many owners and many rows is spread over all tasks, and rows are made where they are read: a row of the set with
    its owners one after the other, which Parquet holds in the least space.
    """
    rows = _pairs(owners, found).select(F.explode("_items").alias("_item"), "_owners").select("_item", F.explode("_owners").alias("_owner"))
    return rows.select("_owner.anchor", *(F.col("_item")[c].alias(c) for c in found.columns if c != "held"))


class Navigator:
    """Queries over a graph, within a scope that views can only narrow."""

    def __init__(self, graph, scope: Scope = Scope()):
        self.graph, self.scope = graph, scope
        #: Walks over the whole graph that several queries start from, found once.
        self._found: dict[tuple, DataFrame] = {}

    def scoped(self, **more) -> Navigator:
        return Navigator(self.graph, self.scope.narrowed(**more))

    # -- tables within the scope

    def table(self, name: str) -> DataFrame:
        df = getattr(self.graph, name)
        return self.scope.all(df) if name == "document" else self.scope.anchors(df)

    def edges(self, *types: str, prefix: str | None = None) -> DataFrame:
        return traverse.of_types(self.table("edges"), list(types), prefix)

    def _hop(self, kind: str) -> DataFrame:
        return self.edges(kind).select("src", "dst")

    @staticmethod
    def _anchored(df: DataFrame, anchors: Iterable[str] | DataFrame | None, column: str = "anchor") -> DataFrame:
        if anchors is None:
            return df
        if isinstance(anchors, DataFrame):
            return df.join(anchors, column, "left_semi")
        return df.where(F.col(column).isin(list(anchors)))

    def _starts(self, df: DataFrame, column: str, anchors) -> DataFrame:
        return self._anchored(df.select(F.col(column).alias("anchor")).distinct(), anchors)

    # -- documents

    def list_root_documents(self, latest_only: bool = False, only_folders: bool = False, only_leaves: bool = False, limit: int | None = None, skip: int | None = None) -> DataFrame:
        if only_folders and only_leaves:
            raise ValueError("only_folders and only_leaves exclude each other")
        df = self.table("document").join(self._hop("IS_COMPOSED_OF").select(F.col("dst").alias("key")), "key", "left_anti")
        df = df.where("latest") if latest_only else df
        df = df.where("is_folder") if only_folders else df.where("NOT is_folder") if only_leaves else df
        return ordered(df, "path", "version", limit=limit, skip=skip)

    def count_root_documents(self, **flags) -> DataFrame:
        return self.list_root_documents(**flags).agg(F.count("*").alias("n"))

    def get_one_document(self, path: str, version: int) -> DataFrame:
        """At most one row; several tenants that have the path make it ambiguous."""
        df = self.table("document").where((F.col("path") == path) & (F.col("version") == version))
        if df.limit(2).count() > 1:
            raise ValueError(f"{path!r} belongs to several tenants")
        return df

    def get_documents(self, path: str | None = None, name_contains: str | None = None, version: int | None = None, latest_only: bool = True, is_folder: bool | None = None, path_prefix: str | None = None, conditions: Mapping[str, Any] | None = None, limit: int | None = None, skip: int | None = None) -> DataFrame:
        df = self.table("document")
        if path is not None:
            df = df.where(F.col("path") == path)
        if name_contains is not None:
            df = df.where(F.contains(F.lower("name"), F.lit(name_contains.lower())))
        if version is not None:
            df = df.where(F.col("version") == version)
        elif latest_only:
            df = df.where("latest")
        if is_folder is not None:
            df = df.where(F.col("is_folder") == is_folder)
        if path_prefix is not None:
            df = df.where(F.col("path").startswith(path_prefix))
        return ordered(where(df, conditions), "path", "version", limit=limit, skip=skip)

    def document_exists(self, paths: DataFrame) -> DataFrame:
        """path, found for each row of paths."""
        have = self.table("document").select("path").distinct().withColumn("hit", F.lit(True))
        return paths.select("path").join(have, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("found"))

    def _documents_below(self, depth: int, anchors=None) -> DataFrame:
        return traverse.walk(self._starts(self.table("document"), "key", anchors), self.edges("IS_COMPOSED_OF"), depth)

    def get_child_documents(self, depth: int = 1, anchors=None, is_folder: bool | None = None) -> DataFrame:
        df = self._documents_below(depth, anchors).join(self.table("document").withColumnRenamed("key", "node"), "node")
        df = df if is_folder is None else df.where(F.col("is_folder") == is_folder)
        return df.select("anchor", "path", "version", "latest", "is_folder", "depth")

    def get_document_tree(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """A row per path below each root, with its lineage; the parent is the last but one of it."""
        p = traverse.paths(self._starts(self.list_root_documents(), "key", anchors), self.edges("IS_COMPOSED_OF"), depth)
        return p.select("anchor", "node", "depth", F.array_join("path", ">").alias("lineage"), F.element_at("path", -2).alias("parent"))

    def get_document_parent(self, anchors=None) -> DataFrame:
        df = self._anchored(self._hop("IS_COMPOSED_OF").select(F.col("dst").alias("anchor"), F.col("src").alias("key")), anchors).join(self.table("document"), "key")
        best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc_nulls_first("version")))
        return df.withColumn("n", best).where("n = 1").select("anchor", "path", "version")

    def get_document_ancestors(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """The longest chain from a root down to, without, the document; nothing if depth does not reach a root."""
        roots = self._starts(self.list_root_documents(), "key", None)
        p = self._anchored(traverse.paths(roots, self.edges("IS_COMPOSED_OF"), depth).select(F.col("node").alias("anchor"), "path", "depth"), anchors)
        return p.groupBy("anchor").agg(F.max_by("path", "depth").alias("path")).select("anchor", F.array_join(F.slice("path", 1, F.size("path") - 1), ">").alias("ancestors"))

    def get_document_leaves(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        inner = self._hop("IS_COMPOSED_OF").select(F.col("src").alias("node"))
        return self._documents_below(depth, anchors).join(inner, "node", "left_anti").select("anchor", "node")

    def list_document_versions(self) -> DataFrame:
        return ordered(self.table("document").select("tenant_id", "path", "version", "latest"), "path", "tenant_id", "version")

    get_version_chain = list_document_versions

    def get_latest_version(self) -> DataFrame:
        return self.table("document").where("latest").select("tenant_id", "path", "version")

    def get_document_stats(self) -> DataFrame:
        """Counts of each document with nodes, all from one set of (document, node) pairs."""
        nodes = self.nodes_of_documents()
        ids = nodes.select("anchor", F.col("node").alias("id"))
        roles = ids.join(self.table("structure_node").select("id", "role"), "id").groupBy("anchor").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("role") == "Section").alias("n_sections"), F.count_if(F.col("role") == "Table").alias("n_tables"))
        units = ids.join(self.table("info_unit").select(F.col("node").alias("id")), "id").groupBy("anchor").agg(F.count("*").alias("n_units"))
        decisions = ids.join(self.table("model_decision").select(F.col("node").alias("id"), "matched_model"), "id").groupBy("anchor").agg(F.count("matched_model").alias("n_matched"), F.count_if(F.col("matched_model").isNull()).alias("n_proposed"))
        results = ids.join(self.table("extraction_result").select(F.col("node").alias("id")), "id").groupBy("anchor").agg(F.count("*").alias("n_results"))
        out = roles
        for part in (units, decisions, results):
            out = out.join(part, "anchor", "left")
        return out.fillna(0)

    # -- structure nodes

    def nodes_of_documents(self, depth: int | None = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """anchor (document key), node, depth of all structure nodes below each document; depth None: to any depth."""
        key = ("nodes", depth)
        if anchors is not None or key not in self._found:
            starts, edges = self._starts(self.table("document"), "key", anchors), self.edges("HAS_STRUCTURE", "HAS_CHILD")
            out = traverse.closure(starts, edges) if depth is None else traverse.walk(starts, edges, depth)
            if anchors is not None:
                return out
            self._found[key] = out
        return self._found[key]

    def get_structure_nodes(self, depth: int = GENERIC_DEPTH, anchors=None, roles: list[str] | None = None, title_contains: str | None = None, theme: str | None = None, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        nodes = self.find_structure_nodes(title_contains=title_contains, theme=theme, conditions=conditions)
        nodes = nodes if roles is None else nodes.where(F.col("role").isin(roles))
        return self.nodes_of_documents(depth, anchors).join(nodes.withColumnRenamed("id", "node"), "node").select("anchor", "node", "role", "title", "appearance_order", "theme")

    def count_structure_nodes(self, depth: int = GENERIC_DEPTH, roles: list[str] | None = None, anchors=None) -> DataFrame:
        return self.get_structure_nodes(depth, anchors, roles).groupBy("anchor").agg(F.count_distinct("node").alias("n"))

    def get_root_structure_nodes(self, anchors=None) -> DataFrame:
        return self._anchored(self._hop("HAS_STRUCTURE").toDF("anchor", "id"), anchors).join(self.table("structure_node"), "id").select("anchor", "id", "role", "title")

    def get_structure_node(self, node_id: str) -> DataFrame:
        return self.table("structure_node").where(F.col("id") == node_id)

    def get_structure_nodes_by_ids(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted (pos, id), first occurrence of each id, missing ids dropped."""
        first = wanted.groupBy("id").agg(F.min("pos").alias("pos"))
        return self.table("structure_node").join(first, "id").select("pos", "id", "role", "title")

    def get_child_nodes(self, depth: int = 1, anchors=None, roles: list[str] | None = None) -> DataFrame:
        df = traverse.walk(self._starts(self.table("structure_node"), "id", anchors), self.edges("HAS_CHILD"), depth).join(self.table("structure_node").withColumnRenamed("id", "node"), "node")
        df = df if roles is None else df.where(F.col("role").isin(roles))
        return df.select("anchor", "node", "role", "appearance_order", "depth")

    def get_structure_subtree(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """A row per path below each section, with the titles of the node's units."""
        sections = self.table("structure_node").where("role = 'Section'")
        p = traverse.paths(self._starts(sections, "id", anchors), self.edges("HAS_CHILD"), depth)
        units = self.table("info_unit").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "title"))), lambda u: u["title"]), "|").alias("units"))
        return p.join(units, "node", "left").select("anchor", "node", "depth", F.element_at("path", -2).alias("parent"), "units")

    def get_parent_node(self, anchors=None) -> DataFrame:
        return self._anchored(self._hop("HAS_CHILD").select(F.col("dst").alias("anchor"), F.col("src").alias("parent")), anchors)

    def get_node_ancestors(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """The chain of nodes from the document's root node to the parent; nothing if depth does not reach it."""
        docs = self._starts(self.table("document").where("NOT is_folder"), "key", None)
        p = traverse.paths(docs, self.edges("HAS_STRUCTURE", "HAS_CHILD"), depth).select(F.col("node").alias("anchor"), "path", "depth")
        p = self._anchored(p, anchors).groupBy("anchor").agg(F.max_by("path", "depth").alias("path"))
        return p.select("anchor", F.array_join(F.slice("path", 2, F.size("path") - 2), ">").alias("ancestors"), F.get("path", F.lit(0)).alias("document"))

    def get_node_path(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        return self.get_node_ancestors(depth, anchors).select("anchor", F.concat_ws(">", "document", F.when(F.col("ancestors") != "", F.col("ancestors")), "anchor").alias("path"))

    def get_document_of_node(self, anchors=None) -> DataFrame:
        return self._anchored(self.nodes_of_documents().select(F.col("node").alias("anchor"), F.col("anchor").alias("document")), anchors)

    def get_sibling_nodes(self, anchors=None, include_self: bool = False) -> DataFrame:
        """Nodes of the same parent; of the same document for its root nodes."""
        up = self.edges("HAS_CHILD", "HAS_STRUCTURE").select("src", "dst")
        df = self._anchored(up.select("src", F.col("dst").alias("anchor")), anchors).join(up.select("src", F.col("dst").alias("sibling")), "src")
        return (df if include_self else df.where("anchor <> sibling")).select("anchor", "sibling")

    def find_structure_nodes(self, title_contains: str | None = None, node_id: str | None = None, role: str | None = None, theme: str | None = None, document_path: str | None = None, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        df = self.table("structure_node")
        if title_contains is not None:
            df = df.where(F.contains(F.lower("title"), F.lit(title_contains.lower())))
        for name, value in (("id", node_id), ("role", role), ("theme", theme)):
            df = df if value is None else df.where(F.col(name) == value)
        if document_path is not None:
            docs = self.table("document").where(F.col("path") == document_path).select(F.col("key").alias("doc"))
            df = df.join(docs, "doc", "left_semi")
        return where(df, conditions)

    def get_nodes_by_theme(self, theme: str) -> DataFrame:
        return self.find_structure_nodes(theme=theme).select("id", "role", "theme")

    def describe_node(self) -> DataFrame:
        """Counts of what hangs from each node, with its decision."""
        n = self.table("structure_node").select(F.col("id").alias("node"), "role", "title")
        children = self.edges("HAS_CHILD").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_children"))
        units = self.table("info_unit").groupBy("node").agg(F.count("*").alias("n_units"))
        decision = self.table("model_decision").select("node", "matched_model")
        return n.join(children, "node", "left").join(units, "node", "left").join(decision, "node", "left").fillna(0, ["n_children", "n_units"])

    # -- info units

    def get_info_units(self, anchors=None, order_by: str = "order") -> DataFrame:
        if order_by not in ("order", "title"):
            raise ValueError("order_by is order or title")
        return ordered(self._anchored(self.table("info_unit").withColumnRenamed("node", "anchor"), anchors), order_by, "uid").select("anchor", "uid", "title", "order")

    def count_info_units(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        units = self.table("info_unit").select("node")
        return self.nodes_of_documents(depth, anchors).join(units, "node").groupBy("anchor").agg(F.count("*").alias("n"))

    def search_info_units(self, text: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The best units by BM25 over title and description: the larger score of the two counts."""
        scores = [self._bm25(field, text, k1, b) for field in ("title", "description")]
        best = scores[0].union(scores[1]).groupBy("uid").agg(F.max("score").alias("score"))
        return ordered(best, "-score", "uid", limit=limit)

    def _bm25(self, field: str, text: str, k1: float, b: float) -> DataFrame:
        terms = sorted(set(re.findall(r"\w+", text.lower())))
        words = F.split(F.lower(F.col(field)), "[^\\p{L}\\p{N}]+")
        units = self.table("info_unit").select("uid", F.filter(words, lambda w: w != "").alias("words"))
        length = F.size("words")
        total = units.agg(F.count("*").alias("units"), F.avg(length).alias("mean"))
        found = units.select("uid", length.alias("length"), F.explode(F.filter("words", lambda w: w.isin(terms))).alias("term"))
        tf = found.groupBy("uid", "length", "term").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))  # one row
        idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return joined.groupBy("uid").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))).alias("score"))

    def get_info_unit(self, uid: str) -> DataFrame:
        return self.table("info_unit").where(F.col("uid") == uid)

    def get_node_for_info_unit(self, anchors=None) -> DataFrame:
        return self._anchored(self._hop("HAS_INFO_UNIT").select(F.col("dst").alias("anchor"), F.col("src").alias("node")), anchors)

    # -- annotation

    def get_model_decision(self, anchors=None) -> DataFrame:
        return self._anchored(self.table("model_decision").select(F.col("node").alias("anchor"), "uid", "matched_model", "confidence", "proposed_model"), anchors)

    def get_document_model_decisions(self, matched_only: bool | None = None, depth: int = GENERIC_DEPTH) -> DataFrame:
        d = self.table("model_decision").select("node", "uid", "matched_model", "confidence")
        d = d if matched_only is None else d.where(F.col("matched_model").isNotNull() if matched_only else F.col("matched_model").isNull())
        return self.nodes_of_documents(depth).join(d, "node").select("anchor", "uid", "matched_model", "confidence")

    def get_document_model_profile(self, depth: int = GENERIC_DEPTH) -> DataFrame:
        df = self.nodes_of_documents(depth).join(self.table("model_decision").select("node", "uid", "matched_model", "proposed_model"), "node", "left")
        return df.groupBy("anchor").agg(F.count("matched_model").alias("matched"), F.count_if(F.col("uid").isNull()).alias("unannotated"), F.array_join(F.array_sort(F.collect_set("proposed_model")), ",").alias("proposed"))

    def get_nodes_by_annotated_model(self, model_class: str) -> DataFrame:
        return self.table("model_decision").where(F.col("matched_model") == model_class).select("node").distinct()

    def get_unannotated_nodes(self, depth: int = GENERIC_DEPTH) -> DataFrame:
        return self.nodes_of_documents(depth).join(self.table("model_decision").select("node"), "node", "left_anti").select("anchor", "node")

    def get_proposed_models(self) -> DataFrame:
        return self.table("model_decision").where("proposed_model IS NOT NULL").groupBy("proposed_model").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))

    def get_annotation_coverage(self, depth: int = GENERIC_DEPTH) -> DataFrame:
        df = self.nodes_of_documents(depth).join(self.table("model_decision").select("node", "uid", "matched_model", "proposed_model"), "node", "left")
        df = df.groupBy("anchor").agg(F.count("*").alias("total"), F.count("uid").alias("annotated"), F.count("matched_model").alias("matched"), F.count("proposed_model").alias("proposed"))
        return df.withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("annotated") / F.col("total")).otherwise(0.0), 6))

    # -- extraction results and instances

    def get_extraction_result(self, anchors=None) -> DataFrame:
        df = self.table("extraction_result").select(F.col("node").alias("anchor"), "uid", "model_class")
        return self._anchored(df, anchors)

    def get_document_extraction_results(self, depth: int = GENERIC_DEPTH, model_class: str | None = None) -> DataFrame:
        x = self.table("extraction_result").select("node", "uid", "model_class")
        x = x if model_class is None else x.where(F.col("model_class") == model_class)
        return self.nodes_of_documents(depth).join(x, "node").select("anchor", "uid", "model_class")

    def _inside(self) -> DataFrame:
        return self.edges(prefix="HAS_").where(~F.col("type").isin("HAS_STRUCTURE", "HAS_CHILD", "HAS_INFO_UNIT", "HAS_DECISION", "HAS_EXTRACTION", "HAS_NEWER_VERSION"))

    def _entries(self, anchors=None) -> DataFrame:
        """anchor (result uid), first: the instances that a result holds itself."""
        inside = self._inside().select(F.col("src").alias("anchor"), F.col("dst").alias("first"))
        return inside.join(self._starts(self.table("extraction_result"), "uid", anchors), "anchor", "left_semi").distinct()

    def _below_entries(self, depth: int) -> DataFrame:
        """first, node, depth: what each instance that some result holds contains, itself included.

        Many results hold the same instances, so what is inside is found for each instance once.
        """
        key = ("contained", traverse.check_depth(depth))
        if key not in self._found:
            entries = self._entries().select(F.col("first").alias("anchor")).distinct()
            own = entries.select(F.col("anchor").alias("first"), F.col("anchor").alias("node"), F.lit(1).alias("depth"))
            if depth > 1:
                below = traverse.walk(entries, self._inside(), depth - 1).where("anchor <> node")
                own = own.union(below.select(F.col("anchor").alias("first"), "node", F.col("depth") + 1))
            self._found[key] = own
        return self._found[key]

    def contained(self, depth: int = CONTAINMENT_DEPTH, anchors=None) -> DataFrame:
        """anchor (result uid), node, depth of the instances that each result contains, over HAS_ edges."""
        owners, sets = self._sets(self._entries(anchors))
        return product(owners, sets.join(self._below_entries(depth), "first").groupBy("held", "node").agg(F.min("depth").alias("depth")))

    @staticmethod
    def _sets(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """anchor, held and held, first: owners of the same first instances share one set, named by its digest.

        What a set holds is then found, and freed of repeats, once for all its owners.
        """
        sets = entries.groupBy("anchor").agg(F.array_sort(F.collect_set("first")).alias("set"))
        sets = stored(sets.select("anchor", F.sha2(F.to_json("set"), 256).alias("held"), "set"))
        return sets.select("anchor", "held"), few(sets.groupBy("held").agg(F.any_value("set").alias("set")).select("held", F.explode("set").alias("first")))

    def _entries_of_nodes(self) -> DataFrame:
        """anchor (node), first: the instances that the results of a node hold themselves."""
        owner = self.table("extraction_result").select(F.col("uid").alias("anchor"), F.col("node").alias("owner"))
        return self._entries().join(owner, "anchor").select(F.col("owner").alias("anchor"), "first").distinct()

    def _entries_of_documents(self) -> DataFrame:
        """anchor (document), first."""
        entries = stored(self._entries_of_nodes().select(F.col("anchor").alias("node"), "first"))
        return self._documents_above(entries.select("node")).join(entries, "node").select("anchor", "first").distinct()

    def _documents_above(self, nodes: DataFrame) -> DataFrame:
        """anchor (document key), node of the given nodes: upwards from them, where not all nodes are known already."""
        if ("nodes", GENERIC_DEPTH) in self._found:
            return self.nodes_of_documents()
        up = traverse.walk(nodes.select(F.col("node").alias("anchor")), traverse.reverse(self.edges("HAS_STRUCTURE", "HAS_CHILD")), GENERIC_DEPTH)
        keys = self.table("document").select(F.col("key").alias("anchor"))
        return up.select(F.col("node").alias("anchor"), F.col("anchor").alias("node")).join(keys, "anchor", "left_semi")

    def _instances(self, model_class: str | None, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        i = self.table("model_instance").withColumnRenamed("uid", "node")
        return where(i if model_class is None else i.where(F.col("model_class") == model_class), conditions).select("node", "model_class")

    def get_node_model_instances(self, model_class: str | None = None, depth: int = CONTAINMENT_DEPTH, direct_only: bool = False, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        held = self._below_entries(1 if direct_only else depth).join(self._instances(model_class, conditions), "node")
        owners, sets = self._sets(self._entries_of_nodes())
        return product(owners, sets.join(held, "first").select("held", "node", "model_class").distinct())

    def get_document_model_instances(self, model_class: str | None = None, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        held = self._below_entries(depth).join(self._instances(model_class), "node")
        owners, sets = self._sets(self._entries_of_documents())
        return product(owners, sets.join(held, "first").select("held", F.col("node").alias("uid"), "model_class").distinct())

    def count_document_model_instances(self, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        """Documents that hold the same first instances have the same counts, found once for each set of them."""
        owners, sets = self._sets(self._entries_of_documents())
        found = sets.join(self._below_entries(depth).join(self._instances(None), "node"), "first").select("held", "node", "model_class").distinct()
        return owners.join(found.groupBy("held", "model_class").agg(F.count("*").alias("n")), "held").select("anchor", "model_class", "n")

    def get_model_instances_by_class(self, model_class: str, conditions: Mapping[str, Any] | None = None, order_by: str | None = None, limit: int | None = None, skip: int | None = None) -> DataFrame:
        i = self.table("model_instance").where(F.col("model_class") == model_class)
        names = [k for k in (conditions or {})] + ([order_by] if order_by else [])
        i = i.select("uid", "model_class", *(F.get(F.array(F.col("props")[n]), F.lit(0)).alias(n) for n in dict.fromkeys(names) if n not in ("uid", "model_class")))
        return ordered(where(i, conditions), *([order_by] if order_by else []), "uid", limit=limit, skip=skip)

    def count_model_instances_by_class(self) -> DataFrame:
        return self.table("model_instance").groupBy("model_class").agg(F.count("*").alias("n"))

    def get_model_instance(self, uid: str) -> DataFrame:
        return self.table("model_instance").where(F.col("uid") == uid)

    def get_structure_nodes_for_model_instance(self, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        owners, sets = self._sets(self._entries_of_nodes())
        found = sets.join(self._below_entries(depth), "first").groupBy("held", F.col("node").alias("uid")).agg(F.min("depth").alias("hops"))
        return product(owners, found).select("uid", F.col("anchor").alias("owner"), "hops")

    def get_documents_for_model_instance(self, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        owners, sets = self._sets(self._entries_of_documents())
        found = sets.join(self._below_entries(depth), "first").select("held", F.col("node").alias("uid")).distinct()
        return product(owners, found).select("uid", F.col("anchor").alias("document"))

    def get_extraction_results_for_model_instance(self, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        return self.contained(depth).select(F.col("node").alias("uid"), F.col("anchor").alias("result"))

    def _instance_edges(self, rel_type: str | None = None) -> DataFrame:
        i = self.table("model_instance").select("uid")
        e = self.edges(*([rel_type] if rel_type else [])).where("label = 'ModelInstance'")
        return e.join(i.select(F.col("uid").alias("src")), "src", "left_semi").join(i.select(F.col("uid").alias("dst")), "dst", "left_semi").select("src", "type", "dst")

    def get_outgoing_model_instances(self, depth: int = GENERIC_DEPTH, rel_type: str | None = None, anchors=None) -> DataFrame:
        """A row per distinct (node, type of the path's first hop)."""
        e = self._instance_edges(rel_type)
        e = stored(e)
        first = self._anchored(e.select(F.col("src").alias("anchor"), "type", F.col("dst").alias("node")), anchors)
        out = level = first.distinct()
        for _ in range(traverse.check_depth(depth) - 1):
            level = level.join(e.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("anchor", "type", F.col("next").alias("node")).distinct()
            level = stored(level.join(out, ["anchor", "type", "node"], "left_anti"))
            if level.isEmpty():
                break
            out = out.union(level)
        return out

    def get_incoming_model_instances(self, depth: int = GENERIC_DEPTH, rel_type: str | None = None, anchors=None) -> DataFrame:
        """A row per distinct (node, type of the path's last hop)."""
        turned = Navigator(self.graph, self.scope)
        turned._instance_edges = lambda rel=None: traverse.reverse(self._instance_edges(rel)).select("src", "type", "dst")
        return turned.get_outgoing_model_instances(depth, rel_type, anchors)

    def get_model_instance_subtree(self, depth: int = GENERIC_DEPTH, anchors=None) -> DataFrame:
        """A row per path below each instance, or below those given."""
        starts = self._starts(self.table("model_instance"), "uid", anchors)
        return traverse.paths(starts, self._instance_edges(), depth).select("anchor", "node", "depth", F.element_at("path", -2).alias("parent"))

    def get_model_instance_relationships(self, direction: str = "both", rel_type: str | None = None, anchors=None) -> DataFrame:
        e = self._instance_edges(rel_type)
        out = e.select(F.col("src").alias("anchor"), "type", F.col("dst").alias("other"), F.lit("out").alias("direction"))
        into = e.select(F.col("dst").alias("anchor"), "type", F.col("src").alias("other"), F.lit("in").alias("direction"))
        if direction not in ("in", "out", "both"):
            raise ValueError("direction is in, out or both")
        return self._anchored({"out": out, "in": into}.get(direction, out.union(into)).distinct(), anchors)

    def get_related_model_instances(self, rel_type: str, direction: str = "out") -> DataFrame:
        return self.get_model_instance_relationships(direction, rel_type).select("anchor", "other")

    def find_shell_model_instances(self) -> DataFrame:
        """Instances with at most three properties, or fewer than half their class's mean."""
        i = self.table("model_instance").select("uid", "model_class", F.size(F.map_filter("props", lambda k, v: v.isNotNull())).alias("n"))
        mean = i.groupBy("model_class").agg(F.avg("n").alias("mean"))
        return i.join(F.broadcast(mean), "model_class").where((F.col("n") <= 3) | (F.col("n") < F.col("mean") / 2)).select("uid", "model_class", "n")

    def list_model_instance_relationship_types(self) -> DataFrame:
        i = self.table("model_instance")
        e = self._instance_edges().where(~F.col("type").startswith("HAS_"))
        e = e.join(i.select(F.col("uid").alias("src"), F.col("model_class").alias("source_class")), "src").join(i.select(F.col("uid").alias("dst"), F.col("model_class").alias("target_class")), "dst")
        return e.groupBy("source_class", "type", "target_class").agg(F.count("*").alias("n"))

    # -- entities

    def get_model_instance_entities(self, label: str | None = None, anchors=None) -> DataFrame:
        le = self.get_labeled_entities(label=label).select(F.col("uid").alias("dst"), "label", "value")
        e = self.edges("REFERENCES").select(F.col("src").alias("anchor"), "dst", F.col("field").alias("field_name"))
        return self._anchored(e, anchors).join(le, "dst").select("anchor", "field_name", "label", "value")

    def _entities_of(self, entries: DataFrame, label: str | None, depth: int) -> DataFrame:
        """Entities of owners (anchor, first): those of each first instance are made distinct before owners multiply them."""
        held = self._below_entries(depth).select("first", F.col("node").alias("anchor")).join(self.get_model_instance_entities(label), "anchor")
        return entries.join(held.select("first", "label", "value").distinct(), "first").select("anchor", "label", "value").distinct()

    def get_node_entities(self, label: str | None = None, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        return self._entities_of(self._entries_of_nodes(), label, depth)

    def get_document_entities(self, label: str | None = None, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        return self._entities_of(self._entries_of_documents(), label, depth)

    def list_entity_labels(self) -> DataFrame:
        return self.table("labeled_entity").groupBy("label").agg(F.count("*").alias("n"))

    def get_labeled_entities(self, label: str | None = None, value: str | None = None, normalized_value: str | None = None, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        df = self.table("labeled_entity")
        for name, wanted in (("label", label), ("value", value), ("normalized_value", normalized_value)):
            df = df if wanted is None else df.where(F.col(name) == wanted)
        return where(df, conditions)

    def get_labeled_entity(self, uid: str) -> DataFrame:
        return self.table("labeled_entity").where(F.col("uid") == uid)

    def get_model_instances_referencing_entity(self, model_class: str | None = None) -> DataFrame:
        i = self.table("model_instance").select(F.col("uid").alias("src"), "model_class")
        i = i if model_class is None else i.where(F.col("model_class") == model_class)
        return self.edges("REFERENCES").join(i, "src").select(F.col("dst").alias("entity"), F.col("src").alias("uid"), "model_class")

    def get_nodes_referencing_entity(self, depth: int = CONTAINMENT_DEPTH) -> DataFrame:
        held = self._below_entries(depth).select("first", F.col("node").alias("src")).join(self.edges("REFERENCES"), "src").select("first", F.col("dst").alias("entity")).distinct()
        return self._entries_of_nodes().join(held, "first").select("entity", F.col("anchor").alias("owner")).distinct()

    def triples(self) -> DataFrame:
        """subject, predicate, object: relations between instances, by their names or keys."""
        names = self.table("model_instance").select("uid", F.coalesce(F.col("props")["name"], F.col("props")["key"]).alias("name"))
        e = self._instance_edges().join(names.select(F.col("uid").alias("src"), F.col("name").alias("subject")), "src")
        return e.join(names.select(F.col("uid").alias("dst"), F.col("name").alias("object")), "dst", "left").select("subject", F.col("type").alias("predicate"), "object")

    def get_entity_triples(self, value: str) -> DataFrame:
        low = value.lower()
        return self.triples().where((F.lower("subject") == low) | (F.lower("object") == low))

    def get_entity_relationships(self, direction: str = "both", rel_type: str | None = None, anchors=None) -> DataFrame:
        """Edges between entities, seen from each entity."""
        ids = self.table("labeled_entity").select("uid")
        e = self.edges(*([rel_type] if rel_type else [])).where("label = 'LabeledEntity'")
        e = e.join(ids.select(F.col("uid").alias("src")), "src", "left_semi").join(ids.select(F.col("uid").alias("dst")), "dst", "left_semi")
        out = e.select(F.col("src").alias("anchor"), "type", F.col("dst").alias("other"), F.lit("out").alias("direction"))
        into = e.select(F.col("dst").alias("anchor"), "type", F.col("src").alias("other"), F.lit("in").alias("direction"))
        if direction not in ("in", "out", "both"):
            raise ValueError("direction is in, out or both")
        return self._anchored({"out": out, "in": into}.get(direction, out.union(into)).distinct(), anchors)

    def get_related_entities(self, rel_type: str, direction: str = "out", anchors=None) -> DataFrame:
        """Entities one hop away by a type of edge."""
        near = self.get_entity_relationships(direction, rel_type, anchors).select("anchor", F.col("other").alias("uid"))
        return near.join(self.table("labeled_entity").select("uid", "label", "value"), "uid").select("anchor", "uid", "label", "value")

    def get_triples(self, anchors=None) -> DataFrame:
        """subject, predicate, object below each node; the object hangs from the subject's result, or is null."""
        m = self._anchored(self.table("mention").withColumnRenamed("node", "anchor"), anchors).select("anchor", "result", "entity")
        names = self.table("labeled_entity").select("uid", "value")
        e = self._entity_edges()
        hit = m.join(e.withColumnsRenamed({"src": "entity", "dst": "other", "type": "predicate"}), "entity")
        hit = hit.join(m.select("result", F.col("entity").alias("other")), ["result", "other"]).select("result", "entity", "predicate", "other")
        df = m.join(hit, ["result", "entity"], "left").join(names.toDF("entity", "subject"), "entity").join(names.toDF("other", "object"), "other", "left")
        return df.select("anchor", "subject", "predicate", "object")

    def _entity_edges(self) -> DataFrame:
        return self.get_entity_relationships("out").select(F.col("anchor").alias("src"), "type", F.col("other").alias("dst"))

    def get_model_instance_by_key(self, wanted: DataFrame, model_class: str, key_fields: list[str]) -> DataFrame:
        """The instance of each row's key fields, in the scope's tenant first, then the public one.

        Keys are compared as they are normalised, and rows without an instance stay out.
        """
        if self.scope.tenant_id is None:
            raise ValueError("a key needs one tenant")
        have = self.table("model_instance").where(F.col("model_class") == model_class)
        keyed = lambda df, get: df.withColumn("_uid", instance_uid(model_class, {k: normalize_key(get(k).cast("string")) for k in key_fields}))
        own = F.when(F.col("tenant_id") == self.scope.tenant_id, 0).otherwise(1)
        found = keyed(have, lambda k: F.col("props")[k]).groupBy("_uid").agg(F.min_by("uid", F.struct(own, "uid")).alias("uid"))
        return keyed(wanted, F.col).join(found, "_uid").select(*wanted.columns, "uid")

    # -- catalogue and introspection

    def list_catalog_models(self, include_fields: bool = False) -> DataFrame:
        """Declared models with their themes; a row per field if asked for."""
        df = self.graph.catalog_model
        if not include_fields:
            return df.select("model_class", "theme")
        return df.select("model_class", "theme", F.explode_outer("fields").alias("f")).select("model_class", "theme", F.col("f.name").alias("field"), F.col("f.type").alias("type"))

    def get_catalog_graph(self, presence: str | None = None) -> dict[str, DataFrame]:
        """models, labels and relations as declared; relations stay only where both ends do."""
        models, labels, relations = self.list_catalog_models(), self.graph.catalog_label, self.graph.catalog_relation
        if presence is not None:
            models = self.list_model_classes_present(models, presence)
            labels = labels.join(self.table("labeled_entity").select("label").distinct(), "label", "left_semi")
            kept = models.select("model_class").union(labels.select("label"))
            relations = relations.join(kept.toDF("source"), "source", "left_semi").join(kept.toDF("target"), "target", "left_semi")
        return {"models": models, "labels": labels, "relations": relations.select("source", "type", "target")}

    def get_catalog_graph_in_use(self, presence: str = "both") -> dict[str, DataFrame]:
        return self.get_catalog_graph(presence)

    def list_node_labels(self) -> DataFrame:
        """Labels that the graph has nodes of."""
        fixed = (("Document", "document"), ("StructureNode", "structure_node"), ("InfoUnit", "info_unit"), ("ModelDecision", "model_decision"), ("ExtractionResult", "extraction_result"), ("ModelInstance", "model_instance"), ("LabeledEntity", "labeled_entity"))
        parts = [self.table(t).limit(1).select(F.lit(label).alias("label")) for label, t in fixed]
        parts += [self.table("structure_node").select(F.col("role").alias("label")).distinct(), self.table("labeled_entity").select("label").distinct()]
        return reduce(DataFrame.union, parts).distinct()

    def list_model_classes_in_use(self) -> DataFrame:
        both = self.table("model_instance").groupBy("model_class").agg(F.count("*").alias("n")).union(self.table("extraction_result").groupBy("model_class").agg(F.count("*").alias("n")))
        return both.groupBy("model_class").agg(F.sum("n").alias("n"))

    def list_model_classes_present(self, classes: DataFrame, presence: str = "both") -> DataFrame:
        """The classes (a column model_class) that have instances or results, decisions, or either."""
        used = self.table("model_instance").select("model_class").union(self.table("extraction_result").select("model_class"))
        noted = self.table("model_decision").select(F.col("matched_model").alias("model_class"))
        have = {"model_instances": used, "annotated": noted, "both": used.union(noted)}[presence]
        return classes.join(have.distinct(), "model_class", "left_semi")

    def get_model_properties(self) -> DataFrame:
        return self.table("model_instance").select("model_class", F.explode(F.map_keys("props")).alias("property")).distinct()

    def list_node_roles(self) -> DataFrame:
        return self.table("structure_node").groupBy("role").agg(F.count("*").alias("n"))

    def list_themes(self) -> DataFrame:
        return self.table("structure_node").select("theme").distinct()

    def list_relationship_types(self) -> DataFrame:
        return self.table("edges").select("type").distinct()

    def get_graph_summary(self) -> DataFrame:
        parts = [self.table(t).agg(F.lit(t).alias("label"), F.count("*").alias("n")) for t in ("document", "structure_node", "info_unit", "model_decision", "extraction_result", "model_instance", "labeled_entity", "edges")]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    # -- generic tools

    def neighbors(self, anchors: DataFrame, depth: int = 1, edge_types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """Nodes within depth; undirected walks do not go back over an edge, so the anchor needs a cycle to appear."""
        e = self.edges(*(edge_types or [])).select("src", "type", "dst")
        if direction == "both":
            return traverse.paths(anchors, e, depth, both=True).groupBy("anchor", "node").agg(F.min("depth").alias("depth"))
        return traverse.walk(anchors, e if direction == "out" else traverse.reverse(e), depth)

    def shortest_path(self, anchors: DataFrame, targets: DataFrame, max_hops: int = 6, edge_types: list[str] | None = None) -> DataFrame:
        """anchor, node, hops, path (nodes), types of one shortest path to each target."""
        return traverse.shortest_paths(anchors, targets, self.edges(*(edge_types or [])), max_hops)

    def subgraph(self, anchors: DataFrame, depth: int = 2, edge_types: list[str] | None = None) -> DataFrame:
        """Edges between any two nodes of the neighbourhood."""
        near = self.neighbors(anchors, depth, edge_types).select("node").union(anchors.select(F.col("anchor").alias("node"))).distinct()
        e = self.edges(*(edge_types or []))
        return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "type", "dst").distinct()

    def execute_raw(self, spark, query: str, params: Mapping[str, Any] | None = None) -> DataFrame:
        """A read-only SQL query over registered views; refused within a scope."""
        if self.scope != Scope():
            raise PermissionError("raw queries know no scope")
        bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", query, flags=re.S)
        if _WRITES.search(bare) or not re.match(r"\s*(select|with|values|\()", bare, re.I):
            raise PermissionError("only reading queries are allowed")
        return spark.sql(query, args=dict(params or {}))

    # -- source text, originals, images

    def get_structure_nodes_source_pages(self, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
        """pages: each page once; nodes: per wanted node its page ids found and not found; missing: unknown node ids."""
        n, p = self.table("node_page"), self.table("page")
        n = n if wanted is None else n.join(wanted.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
        seen = n.join(p.select("page_id", F.lit(True).alias("found")), "page_id", "left")
        ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("page_id"))))
        nodes = seen.groupBy("node").agg(ids(F.col("found")).alias("found"), ids(F.col("found").isNull()).alias("not_found"))
        out = {"pages": p.join(n.select("page_id").distinct(), "page_id", "left_semi"), "nodes": nodes}
        if wanted is not None:
            out["missing"] = wanted.select("id").distinct().join(self.table("structure_node").select("id"), "id", "left_anti")
        return out

    def get_info_unit_source_text(self, anchors=None) -> DataFrame:
        """The page of the node that owns each unit."""
        units = self._anchored(self.table("info_unit").select(F.col("uid").alias("anchor"), "node"), anchors)
        return units.join(self.table("node_page").select("node", "page_id"), "node").join(self.table("page").select("page_id", "page_index", "markdown"), "page_id").select("anchor", "page_index", "markdown")

    def get_document_original(self, anchors=None) -> DataFrame:
        """The original file of each document: size, digest and bytes."""
        return self._anchored(self.table("raw_file").withColumnRenamed("doc", "anchor"), anchors).select("anchor", "size", "sha256", "content")

    def get_document_images(self, anchors=None, page_indexes: list[int] | None = None, kind: str | None = None) -> DataFrame:
        """Stored images without their bytes."""
        df = self._anchored(self.table("image").withColumnRenamed("doc", "anchor"), anchors)
        df = df if page_indexes is None else df.where(F.col("page_index").isin(page_indexes))
        df = df if kind is None else df.where(F.col("kind") == kind)
        return df.select("anchor", "page_index", "image_index", "kind", F.length("content").cast("long").alias("size"))

    def get_page_image(self, document: str, page_index: int, image_index: int) -> DataFrame:
        """One stored image with its bytes."""
        at = (F.col("doc") == document) & (F.col("page_index") == page_index) & (F.col("image_index") == image_index)
        return self.table("image").where(at).select("doc", "page_index", "image_index", "kind", "content")

    def get_document_source_text(self, lines_per_page: int = 100) -> DataFrame:
        """The pages of each document, in order."""
        return self.pages(lines_per_page)

    def pages(self, lines_per_page: int = 100) -> DataFrame:
        i = self.graph._lines.withColumn("page", F.floor(F.col("i") / lines_per_page).cast("int"))
        g = i.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
        return g.select(F.col("doc").alias("anchor"), "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def previous_page(pages: DataFrame) -> DataFrame:
    """Each page's number of characters with that of the page before it, the context of its chunk."""
    w = Window.partitionBy("anchor").orderBy("page")
    return pages.select("anchor", "page", F.length("markdown").alias("size"), F.lag(F.length("markdown")).over(w).alias("before"))


