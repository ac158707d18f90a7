"""Row routing and merging, normalisation keys, document structuring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StringType

from ..plans.store import stored


_STRIP = "^\\s+|\\s+$"


def _plain(c: Column) -> Column:
    """A value as it is compared: white space collapsed, lower case."""
    return F.lower(F.regexp_replace(c, "\\s+", " "))


def _covers(a: Column, x: Column) -> Column:
    """Whether a says all that x says: it holds x's text, or all its words."""
    a, x = _plain(a), _plain(x)
    return F.contains(a, x) | (F.size(F.array_except(F.split(x, " "), F.split(a, " "))) == 0)


def merge_values(values: Column) -> Column:
    """Values without those that another one covers, in order; blanks and nulls are dropped, white space at the ends trimmed."""
    trimmed = F.filter(F.transform(values, lambda v: F.regexp_replace(v, _STRIP, "")), lambda v: v != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(trimmed, empty, lambda acc, x: F.when(F.exists(acc, lambda a: _covers(a, x)), acc).otherwise(F.concat(F.filter(acc, lambda a: ~_covers(x, a)), F.array(x))))


def merge_type(kind: DataType | None) -> str:
    """How several values of a field become one: ``str`` (also for an unknown type), ``list_str`` or ``other``."""
    if kind is None or isinstance(kind, (StringType, NullType)):
        return "str"
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, NullType)):
        return "list_str"
    return "other"


def route_rows(df: DataFrame, key: str, mapping: DataFrame, least: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """key, target, field, value: cells by their column's mapping (column_name, target, field, confidence), merged."""
    cols = [c for c in df.columns if c != key]
    cells = df.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)))).alias("c")).select(key, "c.*").where("value IS NOT NULL")
    # at most one row of mapping for each column of df
    hit = cells.join(F.broadcast(mapping.where(F.col("confidence").isin(*least))), "column_name")
    g = hit.groupBy(key, "target", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return g.select(key, "target", "field", F.array_join(merge_values(F.transform("v", lambda x: x["value"])), "; ").alias("value"))


def raw_rows(df: DataFrame, key: str) -> DataFrame:
    """key, type, value of each cell that is not empty: the fallback without a mapping."""
    from ..functions.keys import column_edge_type

    cells = F.explode(F.array(*(F.struct(column_edge_type(F.lit(c)).alias("type"), F.substring(F.trim(F.col(c).cast("string")), 1, 500).alias("value")) for c in df.columns if c != key)))
    return df.select(key, cells.alias("c")).select(key, "c.*").where("value <> ''")


def normalization_key(kind: str, fields: list[str]) -> Column:
    """The type and a digest of its fields' values, in the order of their names, without empty ones."""
    items = F.filter(F.array(*(F.when(F.col(f) != "", F.concat(F.lit(f + "="), F.lower(F.col(f)))) for f in sorted(fields))), lambda x: x.isNotNull())
    return F.concat(F.lit(kind + ":"), F.md5(F.array_join(items, "|")))


def normalize_distinct(df: DataFrame, key: Column, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with what an external call gives for each distinct key: it runs once per key and is joined back."""
    keyed = df.withColumn("unique_key", key)
    return keyed.join(call(keyed.dropDuplicates(["unique_key"])), "unique_key", "left")


def prefix_parents(nodes: DataFrame, group: str, node_id: str) -> DataFrame:
    """group, id, parent: the deepest other id that is a proper prefix at an underscore; ids with a hyphen have none."""
    ids = nodes.select(group, F.col(node_id).alias("id")).distinct()
    parts = F.split("id", "_")
    prefixes = F.when((F.size(parts) > 1) & ~F.contains("id", F.lit("-")), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "_"))).otherwise(F.array().cast("array<string>"))
    candidates = ids.select(group, "id", F.explode(prefixes).alias("parent")).join(ids.select(group, F.col("id").alias("parent")), [group, "parent"])
    best = candidates.groupBy(group, "id").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return ids.join(best, [group, "id"], "left")


def merge_siblings(nodes: DataFrame, keys: list[str], order: str, default_theme: str = "general") -> DataFrame:
    """Nodes of one parent and id merged: first title, pages of all, first theme that is not the default."""
    g = nodes.groupBy(*keys).agg(F.min_by("title", order).alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.min_by("theme", F.when(F.col("theme") != default_theme, F.col(order))).alias("own"), F.min(order).alias(order))
    return g.withColumn("theme", F.coalesce("own", F.lit(default_theme))).drop("own")


def assemble_tree(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, parent: orphans take the first decision's parent; an unknown one makes a root, and so does a circle, of its orphans.

    nodes: id, parent, is_orphan. decisions: id, parent, seq. A node lies in a circle if it is still among its own
    ancestors after all chains that end have been shortened away, by doubling the reach of every step.
    """
    first = decisions.groupBy("id").agg(F.min_by("parent", "seq").alias("decided"))
    df = nodes.join(first, "id", "left").withColumn("wanted", F.when(F.col("is_orphan"), F.col("decided")).otherwise(F.col("parent")))
    df = df.join(nodes.select(F.col("id").alias("wanted"), F.lit(True).alias("known")), "wanted", "left").withColumn("wanted", F.when(F.col("known"), F.col("wanted"))).select("id", "wanted", "is_orphan")
    # after 2^k steps: where each node stands, and who has ended at a root is gone
    step = stored(df.where("wanted IS NOT NULL").select("id", F.col("wanted").alias("to")))
    reach, left = step, step.count()
    while left:
        reach = stored(reach.join(reach.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")))
        before, left = left, reach.count()
        if left == before:
            break
    # those left lead into circles; the circles are what is reached after so many steps as there are nodes
    seen, size = reach.select(F.col("to").alias("id")).distinct(), -1
    while left and (now := seen.count()) != size:
        size = now
        seen = stored(step.join(seen, "id", "left_semi").select(F.col("to").alias("id")).distinct())
    circle = seen.select("id", F.lit(True).alias("in_circle"))
    return df.join(circle, "id", "left").select("id", F.when(F.col("in_circle").isNull() | ~F.col("is_orphan"), F.col("wanted")).alias("parent"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_entities(rows: DataFrame) -> DataFrame:
    """Keyed merge: the first value by seq stays, provenance accumulates. rows: uid, value, seq, job_id."""
    return rows.groupBy("uid").agg(F.min_by("value", "seq").alias("value"), F.array_sort(F.collect_set("job_id")).alias("job_ids"))


def namespaced(page: Column, node_id: Column) -> Column:
    """A node's id made unique over the pages of a document."""
    return F.concat(F.lit("page-"), page.cast("string"), F.lit("::"), node_id)


def renumbered(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """appearance_order from 1 within siblings."""
    return nodes.withColumn("appearance_order", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def compact_parents(nodes: DataFrame, group: str, top: tuple[str, ...] = ("Section", "Appendix")) -> DataFrame:
    """group, id, parent: top roles stand at the root; others under the parent named, else the deepest prefix, else there.

    nodes: group, id, role, parent_id.
    """
    given = nodes.select(group, "id", "role", "parent_id")
    known = given.select(group, F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    prefix = prefix_parents(nodes, group, "id").withColumnRenamed("parent", "prefix")
    df = given.join(known, [group, "parent_id"], "left").join(prefix, [group, "id"])
    named = F.when(F.col("known") & (F.col("parent_id") != F.col("id")), F.col("parent_id"))
    return df.select(group, "id", F.when(~F.col("role").isin(*top), F.coalesce(named, "prefix")).alias("parent"))


def active_branch(nodes: DataFrame, group: str, order: str, parent: str) -> DataFrame:
    """group, id, level of the rightmost open path: from the last node up to its root.

    The climb ends within the known nodes of a group, as a parent stands before its children.
    """
    last = nodes.groupBy(group).agg(F.max_by("id", order).alias("anchor"))
    up = nodes.where(F.col(parent).isNotNull()).select(group, F.col("id").alias("node"), F.col(parent).alias("next"))
    up = stored(up)
    level = last.select(group, F.col("anchor").alias("node"))
    out = level.withColumn("level", F.lit(0))
    n = 0
    while True:
        n += 1
        # what was met before in the group ends the climb, should parents form a circle
        level = level.join(up, [group, "node"]).select(group, F.col("next").alias("node")).join(out.select(group, "node"), [group, "node"], "left_anti")
        level = stored(level)
        if level.isEmpty():
            return out.withColumnRenamed("node", "id")
        out = out.union(level.withColumn("level", F.lit(n)))


def window_batches(sizes: Column, ceiling: Column | int) -> Column:
    """For an array of chunk sizes, each chunk's batch: a batch and the one before it stay under a ceiling together.

    A chunk that does not fit beside the batch before is a batch of its own. Null sizes count as nothing.
    """
    ceiling = F.lit(ceiling).cast("long") if isinstance(ceiling, int) else ceiling.cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("batch"), zero.alias("used"), zero.alias("before"), F.array().cast("array<long>").alias("out"))

    def put(acc: Column, size: Column) -> Column:
        size = F.coalesce(size.cast("long"), zero)
        fits = (F.size(acc["out"]) == 0) | (acc["before"] + acc["used"] + size <= ceiling)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, acc["used"] + size).otherwise(size).alias("used"), F.when(fits, acc["before"]).otherwise(acc["used"]).alias("before"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, put, lambda acc: acc["out"])


#: Roles whose nodes ask for a parent.
ORPHAN_ROLES = ("Subsection", "Table", "FieldGroup", "FreeformBlock")


def orphan_parents(nodes: DataFrame, decide: Callable[[DataFrame, DataFrame], DataFrame], ceiling: int, roles: tuple[str, ...] = ORPHAN_ROLES) -> DataFrame:
    """group, id, parent of every node whose role asks for one; a null parent is the root.

    nodes: group, chunk (from 0, in order), id, role, size. A group's chunks go into batches (one, if all fit).
    decide(asked, pool) gives group, id, parent; the pool holds a batch and the one before it, asked the batch's orphans and
    those still open. The smallest parent of an orphan counts; one without stays open for the batches after. A round
    takes one batch of every group, so that rounds are as many as the longest group has batches.
    """
    sizes = nodes.groupBy("group", "chunk").agg(F.sum("size").alias("size")).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("chunk", "size"))).alias("c"))
    numbered = sizes.select("group", F.explode(F.arrays_zip(F.col("c.chunk").alias("chunk"), window_batches(F.col("c.size"), ceiling).alias("batch"))).alias("c")).select("group", "c.*")
    placed = stored(nodes.join(numbered, ["group", "chunk"]))
    last = placed.agg(F.max("batch")).first()[0]
    found = placed.select("group", "id", F.lit(None).cast("string").alias("parent")).where("false")
    asking = placed.where(F.col("role").isin(*roles))
    open_ = asking.where("false")
    for batch in range(0 if last is None else last + 1):
        # groups whose batches are over have nothing more to see
        pool = placed.where(F.col("batch").isin(batch - 1, batch))
        live = placed.where(F.col("batch") == batch).select("group").distinct()
        asked = open_.unionByName(asking.where(F.col("batch") == batch))
        given = decide(asked.join(live, "group", "left_semi"), pool.join(live, "group", "left_semi")).where("parent IS NOT NULL").groupBy("group", "id").agg(F.min("parent").alias("parent"))
        given = stored(given.join(asked.select("group", "id"), ["group", "id"], "left_semi"))
        found = found.union(given)
        open_ = stored(asked.join(given, ["group", "id"], "left_anti"))
    return found.union(open_.select("group", "id", F.lit(None).cast("string")))


def output_parts(sizes: list[int], ceiling: float) -> list[tuple[int, int]]:
    """Ranges of items whose outputs, estimated by the mean size, stay under a ceiling; one item at least each."""
    if not sizes:
        return []
    if sum(sizes) <= ceiling:
        return [(0, len(sizes))]
    most = max(1, int(ceiling // max(1, sum(sizes) // len(sizes))))
    return [(s, min(s + most, len(sizes))) for s in range(0, len(sizes), most)]


def best_theme(df: DataFrame, detected: str, themes: DataFrame, default: str = "default") -> DataFrame:
    """df with ``theme``: the longest theme that is a path prefix of the detected one, else the default.

    themes: a column theme, the declared ones.
    """
    parts = F.split(detected, "/")
    tries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asked = df.select(detected).where(F.col(detected).isNotNull()).distinct()
    hit = asked.withColumn("theme", F.explode(tries)).join(themes.select("theme").distinct(), "theme")
    best = hit.groupBy(detected).agg(F.max_by("theme", F.length("theme")).alias("theme"))
    return df.join(best, detected, "left").withColumn("theme", F.coalesce("theme", F.lit(default)))


def annotation_context(nodes: DataFrame, units: DataFrame, children: DataFrame, roles: tuple[str, ...] = ("Table", "FreeformBlock", "Figure")) -> DataFrame:
    """id, title, units, children: what a decision about a node is made from, each list in order.

    nodes: id, title. units: node, order, description. children: src, dst, role, title, appearance_order.
    """
    u = units.groupBy(F.col("node").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "description"))), lambda x: x["description"]).alias("units"))
    c = children.where(F.col("role").isin(*roles)).groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("appearance_order", "title"))), lambda x: x["title"]).alias("children"))
    empty = F.array().cast("array<string>")
    return nodes.join(u, "id", "left").join(c, "id", "left").select("id", "title", F.coalesce("units", empty).alias("units"), F.coalesce("children", empty).alias("children"))
