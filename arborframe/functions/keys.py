"""Keys, uids, paths and edge types as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PUBLIC = "__public__"


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        return None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    return values.map(one)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; texts that are ASCII stay in the JVM."""
    return F.when(F.rlike(c, F.lit("[^\\x00-\\x7F]")), _fold(c)).otherwise(c)


def normalize_key(c: Column, ascii_only: bool = False) -> Column:
    """Accents folded, white space collapsed and stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(c if ascii_only else fold_accents(c), "\\s+", " ")))


def uid(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts, each with its length before it."""
    return F.substring(F.sha2(F.concat_ws("||", *(F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256), 1, 16)


def legacy_uid(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts alone, as units and decisions of older stores have it."""
    return F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16)


def instance_uid(model_class: str, keys: Mapping[str, Column], tenant: Column | None = None) -> Column:
    """The uid of a keyed instance: class, tenant and its key fields in the order of their names."""
    parts = [F.lit("mi"), F.lit(model_class), F.lit("tenant"), tenant_key(tenant)]
    for name in sorted(keys):
        parts += [F.lit(name), keys[name]]
    return uid(*parts)


def tenant_key(tenant: Column | None) -> Column:
    """Null means the public tenant."""
    return F.lit(PUBLIC) if tenant is None else F.coalesce(tenant, F.lit(PUBLIC))


def structure_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def ancestor_paths(path: Column) -> Column:
    """Every folder above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def edge_type(predicate: Column, ascii_only: bool = False) -> Column:
    """A predicate as an edge type."""
    c = F.regexp_replace(predicate if ascii_only else fold_accents(predicate), "[^A-Za-z0-9]+", "_")
    c = F.upper(F.regexp_replace(c, "^_+|_+$", ""))
    return F.when(c == "", "RELATED_TO").otherwise(F.coalesce(c, F.lit("RELATED_TO")))


def column_edge_type(name: Column) -> Column:
    """HAS_ and a column's name; COL_ before a name that starts with a digit."""
    c = F.upper(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))
    return F.concat(F.lit("HAS_"), F.when(F.rlike(c, F.lit("^[0-9]")), F.concat(F.lit("COL_"), c)).otherwise(c))


def redact(c: Column) -> Column:
    """Passwords in URIs masked."""
    return F.regexp_replace(c, "(://[^:/@\\s]+:)[^@/\\s]+@", "$1***@")


def clock(ms: Column) -> Column:
    """HH:MM:SS of milliseconds."""
    s = F.floor(ms / 1000)
    return F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)))
