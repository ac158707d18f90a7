"""Tables with string cells: delimiter, header and row rules, previews."""

from __future__ import annotations

import csv
import io
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DELIMITERS = ",;\t|"
#: Lines with something on them from which the delimiter and the header are read.
SAMPLE_LINES = 200


def sniff(sample: str) -> str:
    """The delimiter that splits the sample's lines most evenly."""
    lines = [x for x in sample.lstrip("\ufeff").splitlines() if x.strip()][:20]
    best = (0.0, ",")
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and max(counts):
            common, times = Counter(c for c in counts if c).most_common(1)[0]
            best = max(best, (times / len(lines) * (1 + common / 100), d), key=lambda x: x[0])
    return best[1]


def header(cells: list[str]) -> list[str]:
    """Names from a first row: stripped, empty ones numbered, repeated ones with _2, _3 and so on."""
    seen: Counter = Counter()
    out = []
    for i, c in enumerate(cells):
        name = c.strip() or f"column_{i + 1}"
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_index and string columns; empty rows are dropped, others trimmed or padded to the header.

    Delimiter and header are read off the first lines that hold something, wherever they stand in the files.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "^\ufeff", "")) != "")
    if not lines.where(F.contains("value", F.lit("\0"))).isEmpty():
        raise ValueError("a NUL byte in a text table")
    first = [r.value.removeprefix("\ufeff") for r in lines.limit(SAMPLE_LINES).collect()]
    sep = sniff("\n".join(first))
    # a quoted cell of the header may hold delimiters and line ends
    records = csv.reader(io.StringIO("\n".join(first)), delimiter=sep)
    top = next((r for r in records if any(c.strip() for c in r)), [])
    raw = spark.read.schema(StructType([StructField(f"c{i}", StringType()) for i in range(max(1, len(top)))])).csv(path, sep=sep, header=False, multiLine=True, escape='"', encoding="UTF-8", mode="PERMISSIVE")
    # the rows are numbered by their place in the files
    rows = raw.select(F.monotonically_increasing_id().alias("at"), F.array(*(clean(F.col(c)) for c in raw.columns)).alias("cells")).where(not_empty(F.col("cells")))
    head = rows.orderBy("at").first()
    if head is None:
        return spark.createDataFrame([], "row_index bigint")
    names = header(head.cells)
    return rows.where(F.col("at") > head["at"]).select(F.col("at").alias("row_index"), *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", ""))


def not_empty(cells: Column) -> Column:
    return F.exists(cells, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def to_width(cells: Column, width: int) -> Column:
    """Cells trimmed or padded with empty ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(cells, i), F.lit("")))


def preview(df: DataFrame, n: int, index: str = "row_index") -> DataFrame:
    """Rows 0, n/4, n/2, 3n/4 and n-1 of n; all of at most five."""
    return df if n <= 5 else df.where(F.col(index).isin(0, n // 4, n // 2, 3 * n // 4, n - 1))


def row_markdown(names: list[str]) -> Column:
    """A row as a table of one line."""
    cells = F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(n), F.lit("")), F.lit("|"), F.lit("\\|")) for n in names))
    return F.concat(F.lit("| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n| "), cells, F.lit(" |"))
