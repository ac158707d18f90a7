"""Exact dedup with a cuckoo-filter index of live digests.

A document's digest is the SHA-256 of its text after runs of ASCII white space became one space. The index has
a cuckoo filter over the digests' fingerprints, so that most new digests are settled without looking at stored
keys; a hit is verified against the full digests kept in buckets. Digests can be deleted again, and a filter
that overflows is rebuilt at twice the size from the stored keys.

As a DataFrame operator the index works twice: first within each task, which pre-aggregates copies before the
shuffle, then over the shuffled digests in their order. Either index holds a bounded number of live digests: in
the first, what exceeds the bound is passed on and deleted; in the second, digests that the order has passed are.
A group of copies of any size so reaches the second step as one row per task. Ids and digests are written once;
rows of groups over ``HOT`` rows, of which there are few, come back by a broadcast join, others by a shuffled one.

Defined results: null counts as empty, and all empty and white-space-only-alike texts follow the same rule.
Rows without an id are copies like others, but an id is preferred to null as the one that stays; rows that
repeat an id are each a row of the group, and all rows with the id that stays are kept, so that a row repeated
with its id and text is kept as often as it stands there. Very long texts are normalised and digested whole, and
only digests move. Other columns are not read, so that their names cannot clash. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, lean, written

#: Live digests of a task's index; rows of a group that make it hot; hot groups that are broadcast at most.
LIVE, HOT, HOT_GROUPS = 100_000, 10_000, 100_000


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each in one of two buckets."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024):
        n = 1
        while n * self.SLOTS * 0.85 < capacity:
            n *= 2
        self.mask = n - 1
        self.buckets: list[list[int]] = [[] for _ in range(n)]
        self.count = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        a = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, a, a ^ self._turn(mark)

    def _turn(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.buckets[a] or mark in self.buckets[b]

    def insert(self, digest: bytes) -> bool:
        """False if no place could be made; the filter must then be rebuilt."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.buckets[at]) < self.SLOTS:
                self.buckets[at].append(mark)
                self.count += 1
                return True
        at = b
        for k in range(self.KICKS):
            bucket = self.buckets[at]
            slot = (mark + k) % self.SLOTS
            mark, bucket[slot] = bucket[slot], mark
            at ^= self._turn(mark)
            if len(self.buckets[at]) < self.SLOTS:
                self.buckets[at].append(mark)
                self.count += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if mark in self.buckets[at]:
                self.buckets[at].remove(mark)
                self.count -= 1
                return True
        return False


class DigestIndex:
    """Live digests with a value each: a cuckoo filter in front of buckets of full digests."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.capacity = capacity
        self.stored: dict[bytes, dict[bytes, list]] = {}
        self.live = self.resizes = self.false_hits = 0

    def get(self, digest: bytes) -> list | None:
        if digest not in self.filter:
            return None
        value = self.stored.get(digest[:4], {}).get(digest)
        self.false_hits += value is None
        return value

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that get() has not found."""
        self.stored.setdefault(digest[:4], {})[digest] = value
        self.live += 1
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes) -> list | None:
        bucket = self.stored.get(digest[:4], {})
        value = bucket.pop(digest, None)
        if value is None:
            return None
        if not bucket:
            del self.stored[digest[:4]]
        self.live -= 1
        self.filter.delete(digest)
        return value

    def _resize(self) -> None:
        # the digest that was pushed out is among the stored keys
        while True:
            self.capacity *= 2
            self.resizes += 1
            self.filter = CuckooFilter(self.capacity)
            if all(self.filter.insert(d) for b in self.stored.values() for d in b):
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.stored.values():
            yield from bucket.items()


def digest_of(text_col: str = "text") -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", " "), 256)


def _merge(batches: Iterator[pa.RecordBatch], live: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    """digest, keep_id, n by digest; ordered: the digests come in their order, so that those passed are complete."""
    index = DigestIndex()

    def rows(items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in items], pa.binary()), pa.array([v[0] for _, v in items], pa.int64()), pa.array([v[1] for _, v in items], pa.int64())], names=["digest", "keep_id", "n"])

    for b in batches:
        digest = None
        for digest, keep, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            value = index.get(digest)
            if value is None:
                index.insert(digest, [keep, n])
            else:
                value[1] += n
                if keep is not None and (value[0] is None or keep < value[0]):
                    value[0] = keep
        if index.live > live:
            if ordered:
                out = [(d, v) for d, v in index.items() if d != digest]
            else:
                # the digests met once go; those met again stay for further copies
                out = [(d, v) for d, v in index.items() if v[1] == 1]
                out = out if len(out) > live // 4 else list(index.items())
            for d, _ in out:
                index.delete(d)
            for i in range(0, len(out), 20_000):
                yield rows(out[i : i + 20_000])
    items = list(index.items())
    for i in range(0, len(items), 20_000):
        yield rows(items[i : i + 20_000])


def groups(rows: DataFrame, live: int = LIVE) -> DataFrame:
    """digest, keep_id, n of each group of equal texts, from rows of (digest binary, keep_id long, n long)."""
    schema = "digest binary, keep_id long, n long"
    partial = rows.mapInArrow(lean(lambda it: _merge(it, live, False)), schema)
    return partial.repartition("digest").sortWithinPartitions("digest").mapInArrow(lean(lambda it: _merge(it, live, True)), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", live: int = LIVE, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(digest_of(text_col)).alias("digest")), "digests")
    found = groups(rows.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n")), live)
    found = written(found.select("digest", "keep_id", F.col("n").alias("group_size")), "groups")
    large = few(found.where(F.col("group_size") > hot), HOT_GROUPS)
    small = rows.join(large.select("digest"), "digest", "left_anti").join(found.where(F.col("group_size") <= hot), "digest")
    out = rows.join(large, "digest").unionByName(small)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
