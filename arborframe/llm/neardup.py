"""Near-duplicates by bottom-k sketches from one hash function.

Each document is a set of shingle hashes; equal sets become one node. A node keeps the k smallest hashes of
its set. Two sets of the wanted similarity share at least ``least`` of them, but for a chance of a millionth
(or by arithmetic, where sets are no larger than k). So, with a node's values ordered from rare to common,
two such nodes meet in an inverted list of one of the first k - least + 1 values: very common lines, lines of
licences and the like stay out of the lists without being dropped from the comparison.

A list of at most ``SHORT`` nodes gives its pairs, which pass the estimate from the sketch of their union. A longer
one links its nodes to its most central node (the one whose values are the most common) only, and these links are
verified at once: they settle groups of copies of one text. The nodes so brought together, by passed pairs and by
long lists, form families. In a family, the nodes outside its leading component are compared with all its nodes,
in blocks of ``BLOCK`` nodes by ``BLOCK`` nodes, each a group of bounded size: estimate, then exact Jaccard on full
sets. A block returns links enough to connect what belongs together, so no pairs of a group are emitted and no
list, group or family is capped.

Node ids are 64-bit digests: of n distinct texts about n * n / 2^65 pairs would wrongly be taken as equal.

Defined results: null texts count as empty; documents without words link with nothing. Rows that repeat an id
are documents of their own; a null id is never the smallest. Very long texts are shingled whole, in a task's memory
one at a time. Other columns are not read, so that their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, lean, shared_dir, strings, written
from .components import components
from .shingles import shingle_set, word_hashes

K, SHORT, BLOCK, CHANCE = 32, 64, 256, 1e-6
#: Shingles that the nodes of a block's side have together, on average, at most (a larger set is a block's alone).
BLOCK_SHINGLES = 100_000
#: Rows that are broadcast at most: of ids, and of sketches.
FEW_IDS, FEW_SKETCHES = 500_000, 100_000


def least_common(k: int, num: int, den: int, chance: float = CHANCE) -> int:
    """The largest c with P(fewer than c of k sketch values are common) under chance."""
    t, total = num / den, 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > chance:
            return max(1, c)
    return k


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_digest(text_col: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text as it is, null as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def sketches(docs: DataFrame, size: int, k: int = K, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, node and sketch (k smallest hashes) of every row; if asked for, text_sha256 too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, sketch = [], [], []
            for words in word_hashes([t.encode("utf-8", "surrogatepass") for t in strings(b.column(1))]):
                s = shingle_set(words, size)
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                sketch.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), *b.columns[2:]], names=["doc_id", "n_shingles", "node", "sketch", *b.schema.names[2:]])

    more = [text_digest(text_col).alias("text_sha256")] if digest else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(lean(run), "doc_id long, n_shingles long, node long, sketch array<long>" + ", text_sha256 string" * digest)


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, least: int, num: int, den: int) -> DataFrame:
    """a, b of the pairs that the sketch of their union lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, sizes = np.empty((len(batch), 2 * k), np.uint64), []
            for side in (0, 1):
                lists = batch.column(2 + side)
                bounds = lists.offsets.to_numpy()
                n = np.diff(bounds)
                half = np.full((len(batch), k), np.uint64((1 << 64) - 1 - side))
                half[np.arange(k)[None, :] < n[:, None]] = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].view(np.uint64)
                both[:, side * k : (side + 1) * k] = half
                sizes.append(n)
            both.sort(axis=1)
            same = both[:, 1:] == both[:, :-1]
            # places in the union of what is in both sketches; only its k smallest values count where a sketch is not a whole set
            place = np.arange(1, 2 * k)[None, :] - np.cumsum(same, axis=1)
            inside = (same & (place < k) & (both[:, 1:] < np.uint64((1 << 64) - 2))).sum(axis=1)
            all_same = same.sum(axis=1) - np.maximum(0, k - sizes[0] - 1) - np.maximum(0, k - sizes[1] - 1)
            union = sizes[0] + sizes[1] - all_same
            whole = (sizes[0] < k) & (sizes[1] < k)
            keep = np.where(whole, den * all_same >= num * union, inside * k >= least * np.minimum(k, union))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _full_sets(wanted: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node, full (the whole set) of the wanted nodes (node, first_id), from the texts once more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(w, size) for w in word_hashes([t.encode("utf-8", "surrogatepass") for t in strings(b.column(0))])]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "full"])

    ids = few(wanted.select(F.col("first_id").alias("want")).distinct(), FEW_IDS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(ids, F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text").mapInArrow(lean(sets), "node long, full binary")
    # rows that share an id with a wanted one, and copies of it, may have come along
    return found.join(few(wanted.select("node"), FEW_IDS), "node", "left_semi").groupBy("node").agg(F.max("full").alias("full"))


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have the similarity, with it."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                union.append(len(x) + len(y) - both)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"])
            yield out.filter(pa.array([den * c >= num * u for c, u in zip(common, union)], pa.bool_()))

    joined = pairs.join(full.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a").join(full.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
    return joined.select("a", "b", "fa", "fb").mapInArrow(lean(judge), "a long, b long, common long, total long")


def _short_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a < b of lists of (key, node, n), each of bounded length."""
    other = lists.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = F.greatest("n", "nb") * num <= F.least("n", "nb") * den
    return lists.join(other, "key").where((F.col("node") < F.col("b")) & near).select(F.col("node").alias("a"), "b").distinct()


def _block_links(k: int, least: int, num: int, den: int):
    """A function from a block's rows (node, full, side) to links that connect its linked nodes."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, side = rows.column("node").to_pylist(), rows.column("side").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("full")]
        at_b = [i for i, x in enumerate(side) if x & 2]
        parent = list(range(len(nodes)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links: list[tuple[int, int]] = []
        if len(nodes) > 1 and at_b:
            sizes = np.array([len(x) for x in sets])
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            bounds = np.r_[0, np.cumsum(sizes)]
            b_sizes = sizes[at_b]
            b_low = np.minimum(b_sizes, k)
            low_ids = np.concatenate([ids[bounds[i] : bounds[i] + min(k, sizes[i])] for i in at_b])
            low_starts = np.r_[0, np.cumsum(b_low)[:-1]]
            mark = np.zeros(ids.max() + 1, bool)
            for i in (i for i, x in enumerate(side) if x & 1):
                # ids are in hash order, so the k smallest of a set come first
                own = ids[bounds[i] : bounds[i + 1]]
                n = sizes[i]
                near = np.maximum(b_sizes, n) * num <= np.minimum(b_sizes, n) * den
                # a looser form of the estimate of the union's sketch: values of one sketch that the other set has
                mark[own] = True
                shared = np.add.reduceat(mark[low_ids], low_starts)
                near &= shared >= np.minimum(least, -(-num * b_low // den))
                for j in np.flatnonzero(near).tolist():
                    other = at_b[j]
                    x, y = top(i), top(other)
                    if x != y:
                        both = int(mark[ids[bounds[other] : bounds[other + 1]]].sum())
                        if den * both >= num * (n + sizes[other] - both):
                            parent[x] = y
                            links.append((nodes[i], nodes[other]))
                mark[own] = False
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return run


def _family_links(families: DataFrame, comps: DataFrame | None, full: DataFrame, k: int, least: int, num: int, den: int, block: int) -> DataFrame:
    """a, b of links inside families (node, family) beyond those of comps."""
    of = families.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else families.withColumn("comp", F.col("node"))
    of = of.join(full.select("node", (F.length("full") / 8).cast("long").alias("m")), "node")
    sizes = of.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum("m").alias("m")).groupBy("family").agg(F.sum("n").alias("size"), F.sum("m").alias("all"), F.max(F.struct("n", "comp", "m")).alias("top"))
    sizes = sizes.select("family", "size", "all", F.col("top.comp").alias("lead"), (F.col("size") - F.col("top.n")).alias("out"), (F.col("all") - F.col("top.m")).alias("rest")).where("out > 0")
    blocks = lambda n, m: F.ceil(F.greatest(F.col(n) / block, F.col(m) / BLOCK_SHINGLES)).cast("int")
    placed = of.join(few(sizes, FEW_IDS), "family").select("node", "family", (F.col("comp") != F.col("lead")).alias("outside"), blocks("out", "rest").alias("na"), blocks("size", "all").alias("nb"))
    h = F.xxhash64("node")
    ai, bi = F.pmod(h, F.col("na")).cast("int"), F.pmod(h, F.col("nb")).cast("int")
    # a node goes to all blocks of its row as one of those outside, and to all of its column as any node
    as_a = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(ai.alias("i"), j.alias("j"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    as_b = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: F.struct(i.alias("i"), bi.alias("j"), F.lit(2).alias("side")))
    cells = placed.select("node", "family", F.explode(F.concat(as_a, as_b)).alias("c")).groupBy("node", "family", "c.i", "c.j").agg(F.sum("c.side").alias("side"))
    cells = cells.select("node", "side", F.xxhash64("family", "i", "j").alias("cell"))
    return cells.join(full, "node").groupBy("cell").applyInArrow(lambda t: _block_links(k, least, num, den)(t), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, k: int = K, short: int = SHORT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links need num/den of the union of two sets.

    digest: with text_sha256, which tells rows that share an id apart.
    """
    shared_dir(docs.sparkSession)
    rows = written(sketches(docs, size, k, id_col, text_col, digest), "rows")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "nodes")
    least = least_common(k, num, den)
    smallest = next(i for i in range(1, den + 2) if i * den >= num * (i + 1))
    values = nodes.where(F.col("n") >= smallest).select("node", "n", F.explode("sketch").alias("v"))
    values = written(values, "values")
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    per_node = Window.partitionBy("node")
    kept_values = F.least("n", F.lit(k))
    must = F.least(F.lit(least), F.ceil(F.col("n") * num / den))
    # values that no other node has come first; rank counts them too
    ranked = values.join(shared, "v").withColumn("single", kept_values - F.count("*").over(per_node)).withColumn("weight", F.sum("df").over(per_node)).withColumn("rank", F.col("single") + F.row_number().over(per_node.orderBy("df", "v")))
    ranked = written(ranked.where(F.col("single") <= kept_values - must).select("node", "n", "v", "weight", "rank", (kept_values - must).alias("slack")), "ranked")
    discard(values)
    # all that is asked of candidates further on: few where they are few, else joined by shuffles
    about = written(nodes.join(few(ranked.select("node", "weight").distinct(), FEW_IDS), "node"), "about")
    sketch_of = few(about.select("node", "sketch"), FEW_SKETCHES)
    full = written(_full_sets(about.select("node", "first_id"), docs, size, id_col, text_col), "full")
    lists = ranked.where(F.col("rank") <= F.col("slack") + 1).select(F.col("v").alias("key"), "node", "n", "weight")
    sized = lists.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("weight", "node", "n")).alias("top")).where("size > 1")
    lists = written(lists.join(sized, "key"), "lists")
    passed = written(_estimated(_short_pairs(lists.where(F.col("size") <= short), num, den), sketch_of, k, least, num, den), "passed")
    near = F.greatest("n", "top.n") * num <= F.least("n", "top.n") * den
    stars = written(lists.where((F.col("size") > short) & (F.col("node") != F.col("top.node"))).select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"), near.alias("near")).distinct(), "stars")
    links = written(_verified(stars.where("near"), full, num, den).select("a", "b"), "links")
    comps = written(components(links), "comps")
    families = written(components(passed.union(stars.select("a", "b"))).toDF("node", "family"), "families")
    merged = written(links.union(_family_links(families, few(comps, FEW_IDS), full, k, least, num, den, block)), "links")
    comps = written(components(merged), "comps")
    for table in (about, ranked, full, lists, passed, stars, links, families, merged):
        discard(table)
    ends = comps.join(nodes.select("node", "first_id"), "node")
    least_id = ends.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    label = comps.join(least_id, "comp").select("node", "component_id")
    alone = nodes.select("node", F.col("first_id"))
    full = alone.join(label, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    more = ["text_sha256"] if digest else []
    out = rows.select("doc_id", "n_shingles", "node", *more).join(full, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
