"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is scaled to unit length, rotated by a random orthogonal matrix, and kept as the signs of its
components (packed bits) with two scalars: its norm, and the inner product of its rotated unit vector with
its own code. These give an estimate of its inner product with a query and a bound of the error that holds
but for a probability set by ``EPSILON`` (standard deviations). Only vectors whose upper bound reaches the
query's 20th best score so far are scored exactly, in double precision, on the original vectors.

Codes are packed and written once, beside the vectors that rerank them. The queries are taken in slabs of bounded
bytes, one job each. A slab is broadcast and all codes pass it in blocks, so neither side is ever held whole and
nothing grows with the table but the number of slabs. The slab's queries are rows too: scored against each other
they give each query a first threshold. Of a slab, each task hands on at most k rows a query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id; only vectors of the query's dimension are its candidates. Rows that share the query's
id are its own. A query id that repeats is answered once, for the smallest of its vectors. Ties go to the
smaller id. Rows that repeat count once. Other columns are not read, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written

EPSILON = 3.0
SLAB_BYTES = 8 << 20
BLOCK = 2048
PAIRS = 1 << 16


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and correction scalars of the rows."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, norms: np.ndarray, align: np.ndarray, turned_queries: np.ndarray, query_norms: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by rows, and the error bound in the same unit."""
    dim = turned_queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs += signs
    signs -= 1
    scale = (norms / (align * np.sqrt(dim))).astype(np.float32)
    about = turned_queries.astype(np.float32) @ signs.T
    about *= scale
    spread = (norms * epsilon * np.sqrt(np.maximum(0.0, 1 - align**2)) / (align * np.sqrt(max(1, dim - 1)))).astype(np.float32)
    return about, query_norms.astype(np.float32)[:, None] * spread[None, :]


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added up in the order of components; equal vectors give equal scores."""
    return (queries * vectors).cumsum(axis=1)[:, -1]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & some)


def _coded(rows: DataFrame) -> DataFrame:
    """vec_id, v, code (packed bits), norm and align of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            code, norm, align = [b""] * len(b), np.empty(len(b)), np.empty(len(b))
            for at, v in _by_size(b.column(1)):
                d = v.shape[1]
                turns.setdefault(d, rotation(d))
                bits, norm[at], align[at] = encode(v, turns[d])
                for i, x in zip(at.tolist(), bits):
                    code[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(norm), pa.array(align)], names=["vec_id", "v", "code", "norm", "align"])

    return rows.mapInArrow(lean(run), "vec_id long, v array<double>, code binary, norm double, align double")


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the lists of each length."""
    bounds = lists.offsets.to_numpy()
    flat, sizes, starts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(bounds), bounds[:-1] - bounds[0]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, vectors, codes, norms and scalars of rows of one dimension, BLOCK at most."""
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for b in batches:
        for at, v in _by_size(b.column(1)):
            codes = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            have = waiting.setdefault(v.shape[1], [])
            have.append((b.column(0).to_numpy()[at], v, codes, b.column(3).to_numpy()[at], b.column(4).to_numpy()[at]))
            if sum(len(x[0]) for x in have) >= BLOCK:
                yield tuple(np.concatenate(x) for x in zip(*waiting.pop(v.shape[1])))
    for have in waiting.values():
        yield tuple(np.concatenate(x) for x in zip(*have))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", epsilon: float = EPSILON, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query, among all rows of vectors but its own."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded = written(_coded(rows), "codes")
    slabs = max(1, -(-n * dim * 8 // slab_bytes))
    out = None
    for slab in range(slabs):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slabs)) == slab).collect()
        sent = spark.sparkContext.broadcast([(d, np.array([r.vec_id for r in held if len(r.v) == d], np.int64), np.array([r.v for r in held if len(r.v) == d])) for d in sorted({len(r.v) for r in held})])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seekers = {d: _Seeker(ids, q, k, epsilon) for d, ids, q in sent.value}
            for ids, vectors, codes, norms, align in _blocks(batches):
                seeker = seekers.get(vectors.shape[1])
                if seeker is not None:
                    seeker.add(ids, vectors, codes, norms, align)
            for seeker in seekers.values():
                yield pa.RecordBatch.from_arrays([pa.array(seeker.ids[seeker.q]), pa.array(seeker.c), pa.array(seeker.s)], names=["query_id", "vec_id", "score"])

        found = coded.mapInArrow(lean(run), schema)
        if slabs > 1:
            found = written(found, "found")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Seeker:
    """The best k found so far for each query of a slab."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, epsilon: float):
        self.ids, self.queries, self.k, self.epsilon = ids, queries, k, epsilon
        self.turned = queries @ rotation(queries.shape[1]).T
        self.norms = np.linalg.norm(queries, axis=1)
        self.q, self.c, self.s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        # the queries are candidates of each other: their k-th best, less rounding, is a threshold that holds for all
        self.floor = np.full(len(ids), -np.inf)
        if len(ids) > k:
            some = queries[: 4 * BLOCK]
            for i in range(0, len(ids), BLOCK):
                scores = queries[i : i + BLOCK] @ some.T
                own = np.arange(i, min(i + BLOCK, len(ids)))
                inside = own < len(some)
                scores[np.flatnonzero(inside), own[inside]] = -np.inf
                if scores.shape[1] > k:
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    self.floor[own] = kth - 1e-9 * (1 + np.abs(kth))

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, align: np.ndarray) -> None:
        step = max(1, (1 << 21) // max(1, len(ids)))
        for i in range(0, len(self.ids), step):
            about, bound = estimate(codes, norms, align, self.turned[i : i + step], self.norms[i : i + step], self.epsilon)
            floor = self.floor[i : i + step]
            # without a threshold yet, the k-th largest lower bound is one
            if len(ids) > 4 * self.k and not np.isfinite(floor).all():
                lift = np.partition(about - bound, -self.k, axis=1)[:, -self.k]
                floor = np.maximum(floor, lift)
            bound += about
            qi, ci = np.divmod(np.flatnonzero(bound >= floor[:, None].astype(np.float32) - 1e-5), len(ids))
            for j in range(0, len(qi), PAIRS):
                a, b = qi[j : j + PAIRS] + i, ci[j : j + PAIRS]
                keep = self.ids[a] != ids[b]
                a, b = a[keep], b[keep]
                # a quick sum first, in any order: the exact one is for those that it lets come near
                quick = np.einsum("ij,ij->i", self.queries[a], vectors[b])
                near = quick >= self.floor[a] - 1e-9 * (1 + np.abs(quick))
                a, b = a[near], b[near]
                score = exact(self.queries[a], vectors[b])
                reach = score >= self.floor[a]
                self.q, self.c, self.s = np.concatenate([self.q, a[reach]]), np.concatenate([self.c, ids[b[reach]]]), np.concatenate([self.s, score[reach]])
            if len(self.q) > 4 * self.k * len(self.ids):
                self._cut()
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.c, -self.s, self.q))
        q, c, s = self.q[order], self.c[order], self.s[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])] if len(q) else np.empty(0, bool)
        q, c, s = q[first], c[first], s[first]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])
        self.q, self.c, self.s = q[rank < self.k], c[rank < self.k], s[rank < self.k]
