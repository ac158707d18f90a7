"""Best-fit packing of token sequences: best-two-fit.

Documents become ids plus one end id. A longer one is cut into pieces of ``capacity``, the first of which
takes what is left over. Full pieces are sequences of their own. The others are packed in groups of bounded
size: a bin is filled greedily with the largest pieces that fit, then its smallest piece is replaced by two
unpacked pieces that fit the gap, widened by that piece, more tightly.

A group has about ``group_pieces`` pieces, dealt by a hash, whatever the size of the input; it costs at most
about one bin that is not full. A group is a histogram of at most ``capacity`` lengths while it is packed.

Null texts count as empty: one piece with the end id only. Rows that repeat are packed again each. Very long
texts give many full pieces. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import lean, strings, written

CAPACITY, END_ID, GROUP_PIECES = 1024, 2, 8192


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(strings(b.column(1))):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    take.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """A bin number and an offset for each length (each at most capacity)."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    # pieces of each length as a stack; ``sizes`` is a bit mask of lengths that still have pieces
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    mask = 0
    for size in stacks:
        mask |= 1 << size

    def take(size: int) -> int:
        nonlocal mask
        got = stacks[size].pop()
        if not stacks[size]:
            del stacks[size]
            mask &= ~(1 << size)
        return got

    def fit(gap: int) -> int:
        """The largest length that has pieces and fits, or 0."""
        return (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1 if mask & ((1 << (gap + 1)) - 1) else 0

    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    number = 0
    while mask:
        inside: list[int] = []
        gap = capacity
        while gap and (size := fit(gap)):
            inside.append(take(size))
            gap -= size
        if gap and len(inside) > 1 and mask:
            small = int(lengths[inside[-1]])
            room = gap + small
            best = (small, 0, 0)  # what fills the room now
            a = fit(room - 1)
            while a and 2 * a >= best[0]:
                b = fit(min(room - a, a))
                if b == a and len(stacks[a]) < 2:
                    b = fit(a - 1) if a > 1 else 0
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = fit(a - 1)
            if best[1]:
                back = inside.pop()
                inside += [take(best[1]), take(best[2])]
                stacks.setdefault(small, []).append(back)
                mask |= 1 << small
        at = 0
        for i in inside:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with the sequence and the place in it that each has."""
    pieces = written(pieces_of(docs, path, capacity, end_id, id_col, text_col), "pieces")
    groups = max(1, round(pieces.where(F.col("length") < capacity).count() / group_pieces))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=2 * ((pdf["part"].to_numpy().astype("int64") << 31) + bins), offset=offsets).drop(columns=["row", "part"])

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    # the row number is part of the hash, so that copies of a row spread over the groups too
    part = numbered.where(F.col("length") < capacity).withColumn("part", F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(groups)))
    packed = part.groupBy("part").applyInPandas(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(packed)
