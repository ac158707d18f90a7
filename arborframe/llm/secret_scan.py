"""Secret scans with multipart credential linking, in built-in functions only.

Base findings are assignments, access identifiers and long hexadecimal strings. Weak candidates are long mixed
tokens, identifiers given by name, and endpoints: each is common in clean text, so it is reported only where the
parts that complete it co-occur in its scope, by an interval join of their places. The scope of a part reaches
``scope`` characters before and after it. A mixed token needs an identifier there, a named identifier needs a
secret, an endpoint needs both.

The join is of places: a part lies in a scope if it ends in the stretch before the candidate or starts in the one
after it. Stretches and places meet by document and place div (scope + 1), an equality, so that a stretch spans two
cells at most and a cell holds a bounded number of parts, however long its document. Rows without candidates
do not take part. Rows are told apart by id and by what was found in them: those alike in both have like links.
Places come from the lengths of what a pattern matches and what it leaves.

Defined results: null texts count as empty; a text without findings has zero counts and empty spans. Rows that
repeat are scanned each, alike; ids may be null. Other columns are not read, so that their names cannot clash. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .places import running

SCOPE = 256


def either_case(words: str) -> str:
    """A pattern for words in either case of A-Z, spelled out, so that engines agree."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


_VALUE = "[A-Za-z0-9+/_.=-]+"
_TIE = "[\"']?\\x20*[:=]\\x20*[\"']?"

#: Base kinds: name, pattern, and the group with the least length that a match needs.
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){_TIE}({_VALUE})"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run from its first AKIA on: what is shorter than 20 fails there and later
HEX = "[0-9a-f]{24,}"
#: Weak kinds.
MIXED = "[A-Za-z0-9+/_-]{32,}"
NAMED = f"({either_case('client_?id|account|login|username|access_?key_?id')}){_TIE}({_VALUE})"
ENDPOINT = "(https?|s3|jdbc:[a-z0-9]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@%+-]+"
KINDS = ("assign", "access", "hex", "mixed", "named", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, MIXED, NAMED, ENDPOINT)))
#: A character sequence without which a kind cannot match; spares most texts the patterns.
NEEDS = {"assign": "[:=]", "access": "AKIA", "named": "[:=]", "endpoint": "://"}


def _found(kind: str) -> list[Column]:
    """What a pattern leaves and matches, as columns, or null where it matches nothing."""
    text, pattern = F.col("t"), F.lit(PATTERNS[kind])
    some = F.rlike(text, pattern)
    if kind == "access":
        some = text.contains("AKIA") & some
    elif kind == "endpoint":
        some = text.contains("://") & some
    elif kind in ("assign", "named"):
        some = (text.contains("=") | text.contains(":")) & some
    cols = [F.when(some, F.split(text, PATTERNS[kind], -1)).alias(f"{kind}_gaps"), F.when(some, F.regexp_extract_all(text, pattern, F.lit(0))).alias(f"{kind}_all")]
    if kind in ("assign", "named"):
        cols.append(F.when(some, F.regexp_extract_all(text, pattern, F.lit(2))).alias(f"{kind}_value"))
    return cols


def _places(kind: str) -> Column:
    """Intervals (s, k, e) of a kind's matches; k is the kind's place in KINDS."""
    number = KINDS.index(kind)
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = F.col(f"{kind}_all")
    at = running(F.transform(f"{kind}_gaps", F.length), F.transform(found, F.length))
    rows = F.transform(at, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e")))
    if kind in ("assign", "named"):
        value = F.col(f"{kind}_value")
        rows = F.filter(F.transform(rows, lambda r, i: F.when(F.length(F.get(value, i)) >= 6, r)), lambda r: r.isNotNull())
    if kind == "mixed":
        # the mix itself: a digit, an upper-case and a lower-case letter
        rows = F.filter(F.transform(rows, lambda r, i: F.when(F.rlike(F.get(found, i), F.lit("[0-9]")) & F.rlike(F.get(found, i), F.lit("[A-Z]")) & F.rlike(F.get(found, i), F.lit("[a-z]")), r)), lambda r: r.isNotNull())
    return F.when(found.isNotNull(), rows).otherwise(empty).alias(kind)


def _near(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The parts (row, p) that have one of the others within their scope and beside them."""
    width = scope + 1
    cell = lambda c: F.floor(c / width)
    places = others.select("row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p.e").alias("at")), F.struct(F.lit(1).alias("side"), F.col("p.s").alias("at")))).alias("x")).select("row", "x.*", cell(F.col("x.at")).alias("cell"))
    before = F.struct(F.lit(0).alias("side"), (F.col("p.s") - scope).alias("low"), F.col("p.s").alias("high"))
    after = F.struct(F.lit(1).alias("side"), F.col("p.e").alias("low"), (F.col("p.e") + scope).alias("high"))
    scopes = parts.select("row", "p", F.explode(F.array(before, after)).alias("x")).select("row", "p", "x.*")
    scopes = scopes.select("*", F.explode(F.array_distinct(F.array(cell(F.col("low")), cell(F.col("high"))))).alias("cell"))
    met = scopes.alias("a").join(places.alias("b"), (F.col("a.row") == F.col("b.row")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.cell") == F.col("b.cell")) & F.col("b.at").between(F.col("a.low"), F.col("a.high")), "left_semi")
    return met.select("row", "p").distinct()


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of s, k, e) and spans (base and linked parts), sorted."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", *(c for kind in KINDS for c in _found(kind)))
    d = d.select("doc_id", *(_places(kind) for kind in KINDS))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    weak = F.concat("mixed", "named", "endpoint")
    d = written(d.select("doc_id", "assign", "access", "hex", base.alias("base"), weak.alias("weak")), "found")
    row = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.sha2(F.to_json(F.struct("base", "weak")), 256).alias("found"))
    # one part alone completes nothing
    open_ = d.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).withColumn("row", row)
    parts = open_.select("row", F.explode(F.concat("base", "weak")).alias("p")).distinct()
    of = lambda *kinds: parts.where(F.col("p.k").isin([KINDS.index(k) for k in kinds]))
    identifiers = of("access", "named")
    mixed = written(_near(of("mixed"), identifiers, scope), "mixed")
    secrets = of("assign", "hex").union(mixed)
    named = _near(of("named"), secrets, scope)
    endpoint = _near(_near(of("endpoint"), identifiers, scope), secrets, scope)
    linked = mixed.union(named).union(endpoint).groupBy("row").agg(F.collect_list("p").alias("linked"))
    more = open_.join(linked, "row", "left").select("doc_id", "assign", "access", "hex", "base", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked"))).alias("spans"))
    return d.where((F.size("weak") == 0) | (F.size("weak") + F.size("base") <= 1)).select("doc_id", "assign", "access", "hex", "base", F.col("base").alias("spans")).union(more)


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", F.get(names, r["k"]), r["s"].cast("string"), r["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def oracle(scope: int = SCOPE) -> str:
    """The same in DuckDB's SQL."""
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    parts = []
    for n, kind in enumerate(KINDS):
        value = f"len(regexp_extract_all(t, '{quoted[kind]}', 2)[i]) >= 6" if kind in ("assign", "named") else "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')" if kind == "mixed" else "true"
        parts.append(f"""
            SELECT doc_id, {n} AS k, s, s + len(m[i]) AS e FROM (
                SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s FROM (
                    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                        SELECT doc_id, t, string_split_regex(t, '{quoted[kind]}') AS g, regexp_extract_all(t, '{quoted[kind]}', 0) AS m FROM d WHERE regexp_matches(t, '{quoted[kind]}'))))
            WHERE {value}""")
    near = f"o.doc_id = p.doc_id AND o.s <= p.e + {scope} AND o.e >= p.s - {scope} AND NOT (o.s < p.e AND p.s < o.e)"
    name = "['" + "', '".join(KINDS) + "']"
    text = f"string_agg({name}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS ({' UNION ALL '.join(parts)}),
        mixed AS (SELECT * FROM p WHERE k = 3 AND EXISTS (SELECT 1 FROM p o WHERE o.k IN (1, 4) AND {near})),
        secret AS (SELECT * FROM p WHERE k IN (0, 2) UNION ALL SELECT * FROM mixed),
        spans AS (SELECT * FROM p WHERE k < 3 UNION ALL SELECT * FROM mixed
            UNION ALL SELECT * FROM p WHERE k = 4 AND EXISTS (SELECT 1 FROM secret o WHERE {near})
            UNION ALL SELECT * FROM p WHERE k = 5 AND EXISTS (SELECT 1 FROM secret o WHERE {near}) AND EXISTS (SELECT 1 FROM p o WHERE o.k IN (1, 4) AND {near})),
        b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {text} AS x FROM p WHERE k < 3 GROUP BY doc_id),
        s AS (SELECT doc_id, {text} AS x FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(b.x, '')) AS base_sha256, coalesce(s.x, '') AS spans
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)"""
