"""Text, HTML and API answers as pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose content is no text.
DROPPED = ("script", "style", "nav", "footer", "head", "noscript", "iframe")


def text_pages(df: DataFrame, key: str, text: str, lines: int = 100) -> DataFrame:
    """key, page, markdown: pages of so many lines; an empty text is one empty page."""
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r")).alias("i", "line"))
    g = rows.groupBy(key, F.floor(F.col("i") / lines).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return g.select(key, "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and tables of a page as markdown blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.dropped = 0
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.prefix = ""

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and self.rows is None:
            self.blocks.append(self.prefix + text)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        if tag in ("td", "th") and self.rows is not None:
            self.text = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif tag == "table":
            self.flush()
            self.rows = []
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
                mark = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
                self.prefix = "  " * (len(self.lists) - 1) + mark
        elif tag in ("p", "div", "section", "article", "br", "main", "body"):
            if tag != "br":
                self.flush()
            else:
                self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped:
            return
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append(" ".join("".join(self.text).split()).replace("|", "\\|"))
            self.text = []
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            self.text = []
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag in ("p", "div", "li", "section", "article") or (len(tag) == 2 and tag[0] == "h"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


def html_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, page, markdown: a page from each first-level heading on."""

    @F.pandas_udf(StringType())
    def convert(values: pd.Series) -> pd.Series:
        return values.map(to_markdown)

    parts = F.split(convert(F.col(html)), "\n\n(?=# )")
    return df.select(key, F.posexplode(parts).alias("page", "markdown"))


def json_items(df: DataFrame, key: str, body: str, items: str, fields: dict[str, str]) -> DataFrame:
    """A row per item of a JSON answer, with fields by path."""
    item = F.explode(F.from_json(F.get_json_object(body, items), "array<string>"))
    return df.select(key, item.alias("item")).select(key, *(F.get_json_object("item", p).alias(n) for n, p in fields.items()))


def xml_items(df: DataFrame, key: str, body: str, path: str) -> DataFrame:
    """A row per text that an XPath finds in an XML answer."""
    return df.select(key, F.posexplode(F.xpath(F.col(body), F.lit(path + "/text()"))).alias("pos", "text"))


#: Kinds of files by extension.
TABULAR, CONVERTIBLE = ("csv", "tsv", "xlsx"), ("pdf", "docx", "pptx", "html", "htm", "txt", "md", "json", "xml", "png", "jpg", "jpeg", "mp3", "wav", "mp4")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, extension, kind of every file below a folder; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    kind = F.when(ext.isin(*TABULAR), "tabular").when(ext.isin(*CONVERTIBLE), "convertible").otherwise("skipped")
    return files.select("path", F.col("length").alias("size"), ext.alias("extension"), kind.alias("kind"))


def segments(duration: Column, step: int, least: int) -> Column:
    """Consecutive [start, end) in milliseconds that cover the duration.

    A last piece shorter than ``least`` (half a step at most) moves the cut before it to a whole second, so that it
    is as long; a duration of nothing is one empty piece.
    """
    n = F.greatest(F.ceil(duration / step), F.lit(1))
    short = min(least, step // 2)
    moved = F.floor((duration - short) / 1000) * 1000
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i > 0) & (i == n - 1) & (duration - i * step < short), moved).otherwise(i * step))
    return F.transform(cuts, lambda c, i: F.struct(c.cast("long").alias("start_ms"), F.coalesce(F.get(cuts, i + 1), duration).cast("long").alias("end_ms")))


def shifted_cues(cues: Column, start: Column, end: Column) -> Column:
    """Cues in absolute time, clipped to their segment, without empty ones."""
    moved = F.transform(cues, lambda c: F.struct(F.greatest(c["start_ms"] + start, start).alias("start_ms"), F.least(c["end_ms"] + start, end).alias("end_ms"), F.trim(c["text"]).alias("text")))
    return F.filter(moved, lambda c: (c["text"] != "") & (c["start_ms"] < c["end_ms"]))
