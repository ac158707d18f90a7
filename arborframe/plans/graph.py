"""The graph's tables, and how the driver's tables map onto them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PART, PARTS_PER_SECTION = 5, 4

#: The label that edges of a type start from, where it is not an instance; plans prune other parts by it.
STARTS = {"IS_COMPOSED_OF": "Document", "HAS_NEWER_VERSION": "Document", "HAS_STRUCTURE": "Document", "HAS_CHILD": "StructureNode", "HAS_INFO_UNIT": "StructureNode", "HAS_DECISION": "StructureNode", "HAS_EXTRACTION": "StructureNode", "HAS_REGION": "ExtractionResult", "REQUESTS": "LabeledEntity"}


def doc_key(tenant: Column, path: Column, version: Column) -> Column:
    return F.concat_ws("::", tenant, path, version.cast("string"))


@dataclass
class Graph:
    """One DataFrame per label, and edges (tenant_id, src, type, dst, field, label), label being that of their start."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


class SampleGraph:
    """The graph that stands for the driver's tables; every table is a lazy plan over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def leaf(self) -> DataFrame:
        folder = F.concat_ws("/", "lang", "source")
        return self.source("documents").select("doc_id", F.col("lang").alias("tenant_id"), folder.alias("folder"), F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("job_id"), F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("created_by_user_id"), "text", F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1).alias("newest"))

    @cached_property
    def document(self) -> DataFrame:
        cols = ("tenant_id", "path", "version", "name", "latest", "is_folder", "job_id", "created_by_user_id")
        version = F.explode(F.sequence(F.lit(1), F.col("newest")))
        leaves = self.leaf.select("*", version.alias("version")).withColumn("name", F.col("doc_id").cast("string")).withColumn("latest", F.col("version") == F.col("newest")).withColumn("is_folder", F.lit(False)).select(*cols)
        none = F.lit(None).cast("string")
        top = self.leaf.select("tenant_id", "folder", "job_id").distinct()
        folders = top.select("tenant_id", F.col("folder").alias("path"), F.lit(1).alias("version"), F.col("job_id").alias("name"), F.lit(True).alias("latest"), F.lit(True).alias("is_folder"), none.alias("job_id"), none.alias("created_by_user_id"))
        roots = top.select("tenant_id").distinct().select("tenant_id", F.col("tenant_id").alias("path"), F.lit(1).alias("version"), F.col("tenant_id").alias("name"), F.lit(True).alias("latest"), F.lit(True).alias("is_folder"), none.alias("job_id"), none.alias("created_by_user_id"))
        return leaves.union(folders).union(roots).withColumn("key", doc_key(F.col("tenant_id"), F.col("path"), F.col("version")))

    @cached_property
    def _lines(self) -> DataFrame:
        key = doc_key(F.col("tenant_id"), F.col("path"), F.col("newest"))
        return self.leaf.select("tenant_id", "doc_id", "created_by_user_id", "job_id", key.alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))

    @cached_property
    def structure_node(self) -> DataFrame:
        per = LINES_PER_PART * PARTS_PER_SECTION
        section, part = F.floor(F.col("i") / per), F.floor(F.col("i") % per / LINES_PER_PART)
        lines = self._lines
        level = lambda df, path, parent, role, title, order, theme: df.select("tenant_id", "doc", F.concat("doc", F.lit("::"), path).alias("id"), parent.alias("parent"), role.alias("role"), title.alias("title"), order.cast("int").alias("appearance_order"), theme.alias("theme"))
        s = F.concat(F.lit("s"), section.cast("string"))
        p = F.concat(s, F.lit("."), part.cast("string"))
        at = lambda x: F.concat("doc", F.lit("::"), x)
        none = F.lit(None).cast("string")
        sections = level(lines.where(F.col("i") % per == 0), s, none, F.lit("Section"), F.concat(F.lit("Section "), section.cast("string")), section, F.lit("general"))
        parts = level(lines.where(F.col("i") % LINES_PER_PART == 0), p, at(s), F.lit("Subsection"), F.concat(F.lit("Part "), part.cast("string")), part, F.lit("general"))
        table = F.col("line").contains("|")
        blocks = level(lines, F.concat(F.lit("b"), F.col("i").cast("string")), at(p), F.when(table, "Table").otherwise("FreeformBlock"), F.substring("line", 1, 30), F.col("i"), F.when(table, "tables").otherwise("general"))
        return sections.union(parts).union(blocks)

    @cached_property
    def info_unit(self) -> DataFrame:
        return self._lines.where("line <> ''").select("tenant_id", F.concat("doc", F.lit("::u"), F.col("i").cast("string")).alias("uid"), F.concat("doc", F.lit("::b"), F.col("i").cast("string")).alias("node"), F.substring("line", 1, 30).alias("title"), F.col("line").alias("description"), F.col("i").alias("order"))

    @cached_property
    def _labels(self) -> DataFrame:
        return self.source("labels").select("doc_id", "quality", "toxic")

    @cached_property
    def model_decision(self) -> DataFrame:
        per = LINES_PER_PART * PARTS_PER_SECTION
        d = self._lines.where(F.col("i") % per == 0).join(self._labels, "doc_id")
        node = F.concat("doc", F.lit("::s"), F.floor(F.col("i") / per).cast("string"))
        return d.select("tenant_id", "doc_id", F.concat(node, F.lit("::d")).alias("uid"), node.alias("node"), F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "Toxic").otherwise("Report")).alias("matched_model"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"), F.when(F.col("quality") == 0, "Junk").alias("proposed_model"))

    @cached_property
    def extraction_result(self) -> DataFrame:
        return self.model_decision.where("matched_model IS NOT NULL").select("tenant_id", "doc_id", F.concat("node", F.lit("::x")).alias("uid"), "node", F.col("matched_model").alias("model_class"))

    @cached_property
    def _places(self) -> DataFrame:
        tenants = F.array(*map(F.lit, ("de", "en", "es", "fr")))
        return self.source("nation").join(self.source("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("tenant_id", F.get(tenants, F.col("n_nationkey") % 4))

    @cached_property
    def _customers(self) -> DataFrame:
        return self.source("customer").join(F.broadcast(self._places.select("tenant_id", "n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def _orders(self) -> DataFrame:
        return self.source("orders").join(self._customers.select("tenant_id", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))

    @staticmethod
    def _uid(kind: str, *parts: str) -> Column:
        return F.concat_ws(":", F.lit(kind), *(F.col(p).cast("string") for p in parts))

    @cached_property
    def model_instance(self) -> DataFrame:
        """uid, class and open properties as a map."""
        row = lambda df, kind, keys, props: df.select("tenant_id", self._uid(kind, *keys).alias("uid"), F.lit(kind).alias("model_class"), F.create_map(*(x for name, c in props for x in (F.lit(name), F.col(c).cast("string")))).alias("props"))
        regions = row(self._places.select("tenant_id", "r_regionkey", "r_name").distinct(), "Region", ("tenant_id", "r_regionkey"), (("name", "r_name"),))
        nations = row(self._places, "Nation", ("n_nationkey",), (("name", "n_name"),))
        customers = row(self._customers, "Customer", ("c_custkey",), (("name", "c_name"), ("segment", "c_mktsegment"), ("key", "c_custkey"), ("nation", "c_nationkey")))
        orders = row(self._orders, "Order", ("o_orderkey",), (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("key", "o_orderkey"), ("customer", "o_custkey")))
        return regions.union(nations).union(customers).union(orders)

    @cached_property
    def labeled_entity(self) -> DataFrame:
        from ..functions.keys import normalize_key, uid

        found = self._customers.select("tenant_id", F.lit("Segment").alias("label"), F.col("c_mktsegment").alias("value")).union(self._orders.select("tenant_id", F.lit("Priority"), "o_orderpriority")).where("value IS NOT NULL").distinct()
        norm = normalize_key(F.col("value"), ascii_only=True)
        return found.select("tenant_id", uid(F.lit("le"), F.col("tenant_id"), F.col("label"), norm).alias("uid"), "label", "value", norm.alias("normalized_value"))

    @cached_property
    def mention(self) -> DataFrame:
        """Entities that hang from an extraction result: its document's number picks them by their length."""
        found = self.labeled_entity.select("tenant_id", F.col("uid").alias("entity"), (F.length("value") % 3).cast("long").alias("pick"))
        return self.extraction_result.withColumn("pick", F.col("doc_id").cast("long") % 3).join(found, ["tenant_id", "pick"]).select("tenant_id", "node", F.col("uid").alias("result"), "entity")

    @cached_property
    def page(self) -> DataFrame:
        """Stored pages: the text of a document's sections, by their order."""
        per = LINES_PER_PART * PARTS_PER_SECTION
        g = self._lines.groupBy("tenant_id", "doc", F.floor(F.col("i") / per).cast("int").alias("page_index")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
        return g.select("tenant_id", "doc", "page_index", F.concat_ws("::p", "doc", F.col("page_index").cast("string")).alias("page_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))

    @cached_property
    def node_page(self) -> DataFrame:
        """The stored page that each structure node comes from."""
        section = F.regexp_extract("id", "::[sb]([0-9]+)[^:]*$", 1).cast("int")
        per = LINES_PER_PART * PARTS_PER_SECTION
        at = F.when(F.col("role").isin("Section", "Subsection"), section).otherwise(F.floor(section / per)).cast("int")
        return self.structure_node.select("tenant_id", F.col("id").alias("node"), "doc", F.concat_ws("::p", "doc", at.cast("string")).alias("page_id"))

    @cached_property
    def raw_file(self) -> DataFrame:
        """Originals as they were uploaded, with size and digest."""
        key = doc_key(F.col("tenant_id"), F.col("path"), F.col("newest"))
        return self.leaf.select("tenant_id", key.alias("doc"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).withColumn("size", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))

    @cached_property
    def image(self) -> DataFrame:
        """Stored images: one for each table row of a document, its bytes the row's."""
        tables = self._lines.where(F.contains("line", F.lit("|")))
        per = LINES_PER_PART * PARTS_PER_SECTION
        return tables.select("tenant_id", "doc", F.floor(F.col("i") / per).cast("int").alias("page_index"), F.col("i").alias("image_index"), F.when(F.length("line") > 40, "figure").otherwise("icon").alias("kind"), F.encode("line", "UTF-8").alias("content"))

    @cached_property
    def catalog_model(self) -> DataFrame:
        from .catalogue import SAMPLE

        return SAMPLE.models(self.spark)

    @cached_property
    def catalog_relation(self) -> DataFrame:
        from .catalogue import SAMPLE

        return SAMPLE.relations(self.spark)

    @cached_property
    def catalog_label(self) -> DataFrame:
        from .catalogue import SAMPLE

        return SAMPLE.labels(self.spark)

    def _edge(self, df: DataFrame, src: Column, kind: str, dst: Column, name: str | None = None) -> DataFrame:
        return df.select("tenant_id", src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), F.lit(name).cast("string").alias("field"), F.lit(STARTS.get(kind, "ModelInstance")).alias("label"))

    @cached_property
    def edges(self) -> DataFrame:
        from ..functions.keys import normalize_key, uid

        e, doc = self._edge, self.document
        one = F.lit(1)
        n, u, x = self.structure_node, self.info_unit, self.extraction_result
        later = self.leaf.where("newest = 2")
        entity = lambda label, c: uid(F.lit("le"), F.col("tenant_id"), F.lit(label), normalize_key(F.col(c), ascii_only=True))
        asked = self.source("orders").join(self._customers.select("tenant_id", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).where("c_mktsegment IS NOT NULL AND o_orderpriority IS NOT NULL").select("tenant_id", "c_mktsegment", "o_orderpriority").distinct()
        orders = self._orders.withColumn("next", F.expr("lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"))
        parts = [
            e(doc.where("is_folder AND path <> tenant_id"), doc_key(F.col("tenant_id"), F.col("tenant_id"), one), "IS_COMPOSED_OF", F.col("key")),
            e(doc.where("NOT is_folder"), doc_key(F.col("tenant_id"), F.regexp_extract("path", "^(.*)/[^/]*$", 1), one), "IS_COMPOSED_OF", F.col("key")),
            e(later, doc_key(F.col("tenant_id"), F.col("path"), one), "HAS_NEWER_VERSION", doc_key(F.col("tenant_id"), F.col("path"), F.lit(2))),
            e(n.where("parent IS NULL"), F.col("doc"), "HAS_STRUCTURE", F.col("id")),
            e(n.where("parent IS NOT NULL"), F.col("parent"), "HAS_CHILD", F.col("id")),
            e(u, F.col("node"), "HAS_INFO_UNIT", F.col("uid")),
            e(self.model_decision, F.col("node"), "HAS_DECISION", F.col("uid")),
            e(x, F.col("node"), "HAS_EXTRACTION", F.col("uid")),
            e(x.join(F.broadcast(self._places.select(F.col("tenant_id").alias("t"), F.col("r_regionkey").alias("k")).distinct()), (F.col("t") == F.col("tenant_id")) & (F.col("k") == F.col("doc_id") % 5)), F.col("uid"), "HAS_REGION", F.concat_ws(":", F.lit("Region"), "tenant_id", (F.col("doc_id") % 5).cast("string"))),
            e(self._places, self._uid("Region", "tenant_id", "r_regionkey"), "HAS_NATION", self._uid("Nation", "n_nationkey")),
            e(self._customers, self._uid("Nation", "n_nationkey"), "HAS_CUSTOMER", self._uid("Customer", "c_custkey")),
            e(self._orders, self._uid("Customer", "c_custkey"), "HAS_ORDER", self._uid("Order", "o_orderkey")),
            e(orders.where("next IS NOT NULL"), self._uid("Order", "o_orderkey"), "FOLLOWED_BY", self._uid("Order", "next")),
            e(self._customers.where("c_mktsegment IS NOT NULL"), self._uid("Customer", "c_custkey"), "REFERENCES", entity("Segment", "c_mktsegment"), "segment"),
            e(self._orders.where("o_orderpriority IS NOT NULL"), self._uid("Order", "o_orderkey"), "REFERENCES", entity("Priority", "o_orderpriority"), "priority"),
            e(asked, entity("Segment", "c_mktsegment"), "REQUESTS", entity("Priority", "o_orderpriority")),
        ]
        return reduce(DataFrame.union, parts)
