"""Embedded images, windows of long files, transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the image selection and of windows of pages.
MIN_SIDE, IMAGES_PER_PAGE = 64, 10
WINDOW_PAGES, WINDOW_BYTES = 900, 45 << 20


def select_images(images: DataFrame, document: str, least: int = MIN_SIDE, per_page: int = IMAGES_PER_PAGE) -> DataFrame:
    """Images worth describing: not small, not seen before in the document, the largest of each page.

    images: document, page, index, width, height, content. A repeat is an image with the bytes of an earlier one
    that was large enough. Of images with one page and index the larger comes first, then the wider, then the lesser
    digest, so that the result does not hang on the order of rows. Its order is by page and index where it is sorted.
    """
    area = F.desc(F.col("width").cast("long") * F.col("height"))
    big = images.where(F.least("width", "height") >= least).withColumn("_digest", F.sha1("content"))
    first = F.row_number().over(Window.partitionBy(document, "_digest").orderBy("page", "index", area, F.desc("width")))
    fresh = big.withColumn("_n", first).where("_n = 1")
    largest = F.row_number().over(Window.partitionBy(document, "page").orderBy(area, "index", F.desc("width"), "_digest"))
    return fresh.withColumn("_n", largest).where(F.col("_n") <= per_page).drop("_n", "_digest")


def page_windows(pages: int, total: int, size: Callable[[int, int], int], most_pages: int = WINDOW_PAGES, most: int = WINDOW_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) that cover all pages, each within most_pages and, as size() says, most bytes.

    total: the file's bytes, whose mean a page sets the first width; a range that is too large is halved, and a
    single page that is too large is an error.
    """
    width = max(1, min(most_pages, most * pages // max(1, total)))
    todo = [(s, min(s + width, pages)) for s in range(0, pages, width)][::-1]
    while todo:
        start, end = todo.pop()
        if size(start, end) <= most:
            yield start, end
        elif end - start == 1:
            raise ValueError(f"page {start} is larger than {most} bytes")
        else:
            middle = (start + end) // 2
            todo += [(middle, end), (start, middle)]


def find_in_transcript(cues: Column, text: str) -> Column:
    """The cues that hold a text, whatever its case and white space."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    wanted = " ".join(text.lower().split())
    return F.filter(cues, lambda c: F.contains(plain(c["text"]), F.lit(wanted)) & F.lit(wanted != ""))
