"""Connected components of links: in one task up to a bound, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, written

#: Links that one task takes, in arrays of some 100 bytes a link; more are worked off by stars.
ONE_TASK = 1_000_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links that come, smallest node first."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[side] for p in parts]) for side in (0, 1))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    over = np.arange(len(nodes))
    while len(a):
        # the larger of two roots goes under the smallest root that it is linked with, then every node under its root
        x, y = np.maximum(over[a], over[b]), np.minimum(over[a], over[b])
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(over, x, y)
        while (up := over[over]).tobytes() != over.tobytes():
            over = up
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(nodes[over[i : i + 50_000]])], names=["node", "comp"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of links (a long, b long).

    Up to ``one_task`` links, counted first, are joined in one task; more by distributed stars.
    """
    if links.limit(one_task + 1).count() <= one_task:
        return links.select("a", "b").coalesce(1).mapInArrow(lean(_union), "node long, comp long")
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours point to the smallest one around
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: so do the smaller neighbours and the node itself
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        discard(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
