"""Writing records as graph rows: nested instances, keyed links with shells, entity links, triples, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.keys import edge_type, instance_uid, normalize_key, tenant_key, uid

MAX_DEPTH = 10


def instance_rows(df: DataFrame, root: str, value: str, depth: int = MAX_DEPTH) -> dict[str, DataFrame]:
    """A nested record as graph rows, with a plan for each struct of its schema.

    df: uid (the owner's) and a struct column ``value``. nodes: uid, model_class (the field's path), props;
    edges: src, type, dst. A nested node's uid derives from its owner's, its field and its place in a list.
    Null structs and null cells make nothing; below depth nested structs stay inside their owner as JSON.
    """
    nodes, edges = [], []

    def visit(rows: DataFrame, kind: StructType, path: str, left: int) -> None:
        nested = [f for f in kind.fields if left > 1 and _inner(f.dataType) is not None]
        plain = [f for f in kind.fields if f not in nested]
        cells = [(f.name, F.col("v")[f.name]) for f in plain]
        text = [F.struct(F.lit(n).alias("key"), _text(c, kind[n].dataType).alias("value")) for n, c in cells]
        props = F.map_from_entries(F.filter(F.array(*text), lambda x: x["value"].isNotNull())) if text else F.create_map().cast("map<string,string>")
        nodes.append(rows.select("uid", F.lit(path).alias("model_class"), props.alias("props")))
        for f in nested:
            several = isinstance(f.dataType, ArrayType)
            items = F.posexplode(F.col("v")[f.name] if several else F.array(F.col("v")[f.name]))
            below = rows.select(F.col("uid").alias("owner"), items.alias("pos", "v")).where("v IS NOT NULL")
            below = below.select("owner", "v", uid(F.lit("mi"), F.col("owner"), F.lit(f.name), F.col("pos").cast("string")).alias("uid"))
            edges.append(below.select(F.col("owner").alias("src"), F.lit("HAS_" + f.name.upper()).alias("type"), F.col("uid").alias("dst")))
            visit(below.select("uid", "v"), _inner(f.dataType), f"{path}.{f.name}", left - 1)

    visit(df.where(F.col(value).isNotNull()).select("uid", F.col(value).alias("v")), df.schema[value].dataType, root, depth)
    none = df.select(F.col("uid").alias("src"), F.lit("").alias("type"), F.col("uid").alias("dst")).where("false")
    return {"nodes": reduce(DataFrame.union, nodes), "edges": reduce(DataFrame.union, edges, none)}


def _inner(kind) -> StructType | None:
    kind = kind.elementType if isinstance(kind, ArrayType) else kind
    return kind if isinstance(kind, StructType) else None


def _text(c: Column, kind) -> Column:
    return F.to_json(c) if isinstance(kind, (ArrayType, MapType, StructType)) else c.cast("string")


def sibling_links(references: DataFrame, rules: DataFrame) -> DataFrame:
    """Links between the entities of one instance's fields: distinct src, type, dst.

    references: instance, field, entity. rules: model-wide (field, type, to_field), a small declared table.
    """
    left = references.join(rules, "field").select("instance", "type", F.col("to_field").alias("field"), F.col("entity").alias("src"))
    return left.join(references.select("instance", "field", F.col("entity").alias("dst")), ["instance", "field"]).select("src", "type", "dst").distinct()


def keyed_links(df: DataFrame, source: str, items: str, target_class: str, fanout: str, fixed: dict[str, str], rel_type: str, tenant: str | None = None) -> dict[str, DataFrame]:
    """Links from each record to the instances that its list names by key, and shells for the targets.

    ``items`` is an array column that fans out into the target's key field ``fanout``; ``fixed`` maps further key
    fields of the target to columns of df. A record with a blank fixed field links to nothing, null items are
    skipped. tenant: a column of df, for targets are a tenant's own. edges: src, type, dst; shells: uid, model_class, props (the keys only).
    """
    ready = df.where(reduce(lambda a, b: a & b, [F.trim(F.col(c).cast("string")) != "" for c in fixed.values()], F.lit(True)))
    norm = lambda c: normalize_key(c.cast("string"))
    flat = ready.select(F.col(source).alias("src"), F.explode(items).alias("_item"), (F.col(tenant) if tenant else F.lit(None).cast("string")).alias("_tenant"), *(norm(F.col(c)).alias(f"k_{k}") for k, c in fixed.items())).where("_item IS NOT NULL")
    keys = {fanout: norm(F.col("_item"))} | {k: F.col(f"k_{k}") for k in fixed}
    rows = flat.select("src", instance_uid(target_class, keys, F.col("_tenant")).alias("dst"), F.create_map(*(x for k, c in sorted(keys.items()) for x in (F.lit(k), c))).alias("props"))
    shells = rows.groupBy(F.col("dst").alias("uid")).agg(F.any_value("props").alias("props")).select("uid", F.lit(target_class).alias("model_class"), "props")
    return {"edges": rows.select("src", F.lit(rel_type).alias("type"), "dst").distinct(), "shells": shells}


def with_shells(instances: DataFrame, shells: DataFrame) -> DataFrame:
    """Instances and the shells of those that are not there yet; what is there stays as it is."""
    return instances.select("uid", "model_class", "props").union(shells.join(instances.select("uid"), "uid", "left_anti").select("uid", "model_class", "props"))


def write_triples(triples: DataFrame, tenant: str | None = None) -> dict[str, DataFrame]:
    """Entities and links of triples (subject, predicate, object, seq); incomplete ones are skipped.

    tenant: a column of triples, for an entity is one tenant's.
    entities: uid, value (the first spelling). edges: src, type, dst, predicate (the first spelling of a type).
    """
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in ("subject", "predicate", "object")])
    owner = tenant_key(F.col(tenant) if tenant else None)
    key = lambda c: uid(F.lit("entity"), owner, normalize_key(F.col(c)))
    t = triples.where(whole).select(key("subject").alias("src"), edge_type(F.col("predicate")).alias("type"), key("object").alias("dst"), "subject", "predicate", "object", "seq")
    ends = t.select(F.col("src").alias("uid"), F.col("subject").alias("value"), (F.col("seq") * 2).alias("at")).union(t.select("dst", "object", F.col("seq") * 2 + 1))
    entities = ends.groupBy("uid").agg(F.min_by("value", "at").alias("value"))
    return {"entities": entities, "edges": t.groupBy("src", "type", "dst").agg(F.min_by("predicate", F.struct("seq", "predicate")).alias("predicate"))}


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a new row replaces an existing one (columns and their order are existing's)."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*existing.columns))


def instantiate(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """df with a struct ``record`` of fields tried as their types (SQL names); null where a value does not fit.

    The record is null when none of its fields has a value.
    """
    cells = [F.col(f"`{c}`").try_cast(t).alias(c) for c, t in fields.items()]
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").try_cast(t).isNotNull() for c, t in fields.items()])
    return df.withColumn("record", F.when(some, F.struct(*cells)))


def source_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value of those fields that hold something: no null, empty text or empty list."""
    parts = []
    for f in fields:
        several = isinstance(df.schema[f].dataType, ArrayType)
        value = F.when(F.size(f) > 0, F.to_json(f)) if several else F.col(f).cast("string")
        parts.append(F.struct(F.lit(f).alias("field"), value.alias("value")))
    return df.select(key, F.explode(F.filter(F.array(*parts), lambda x: F.coalesce(x["value"] != "", F.lit(False)))).alias("c")).select(key, "c.*")
