"""Which function reads which kind of file, and where originals and pages are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import read_pages, read_xlsx
from .text import discover, html_pages, text_pages

Reader = Callable[[SparkSession, str], DataFrame]


def _whole(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}")
    return files.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")


class Registry:
    """Readers of pages by extension; overrides replace them, external ones (OCR, speech) are added."""

    def __init__(self, overrides: dict[str, Reader] | None = None):
        text = lambda e: lambda s, d: text_pages(_whole(s, d, e), "path", "value")
        html = lambda e: lambda s, d: html_pages(_whole(s, d, e), "path", "value")
        office = lambda e: lambda s, d: read_pages(s, d, e).where("error IS NULL").select("path", "page", "markdown")
        self.readers: dict[str, Reader] = {"txt": text("txt"), "md": text("md"), "html": html("html"), "htm": html("htm"), "docx": office("docx"), "pptx": office("pptx")}
        self.readers |= overrides or {}
        self.tables: dict[str, Reader] = {"xlsx": read_xlsx}

    def read(self, spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
        """path, page, markdown of all files below a folder that a reader knows."""
        parts = [self.readers[e](spark, folder).select("path", "page", "markdown") for e in extensions or self.readers]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


def dry_run(spark: SparkSession, folder: str) -> DataFrame:
    """kind, extension, files and bytes that a run over the folder would meet."""
    return discover(spark, folder).groupBy("kind", "extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, sha256, content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def store_pages(pages: DataFrame, table: str) -> None:
    """Pages as a Parquet table."""
    pages.write.mode("overwrite").parquet(table)


def stored_pages(spark: SparkSession, table: str, path: str | None = None) -> DataFrame:
    """Stored pages, of one file if named, by their index."""
    df = spark.read.parquet(table)
    return (df if path is None else df.where(F.col("path") == path)).orderBy("path", "page")
