"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with
each, in blocks of ``BLOCK`` bytes so that the dictionary and not the text's own start supplies the matches;
the difference of the two sizes, normalised by the text's own size, is calibrated to a probability by isotonic
regression on labelled rows that the dictionaries have not seen.

The fit uses at most ``FIT_ROWS`` labelled rows per dictionary and as many for calibration, the first ones by a
hash of the id; of these, rows of more than ``FIT_CHARS`` characters, or without a text among docs, are left out:
a documented bound of the sample. Rows whose crc32(id as text) mod 5 is 0 are held out of it. Scores are of whole
texts, whatever their length, block by block, and use nothing but the text.

Defined results: null texts count as empty; an empty text has the difference 0 and the score of that. Without
labels of both kinds every score is 1 (nothing is known against a text). A row with several labels counts once
for each. A null id is never held out, and never labelled. Rows that repeat are scored each, alike; an empty table
gives an empty result. score() returns its own columns only; accepted() hands on all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import lean, strings

FIT_ROWS, FIT_CHARS, DICTIONARY_BYTES, BLOCK, LEVEL, ACCEPT = 2500, 20_000, 112_640, 2048, 3, 0.3
#: Bytes that count beside a text's own, so that the difference of a very short text stays small.
SMALL = 60


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def compressors(self) -> tuple:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(out)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def difference(text: str, good, bad) -> float:
    """The normalised compressed-size difference: over 0 if the good dictionary serves better."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    a = b = 0
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        a += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - a) / (len(data) + SMALL)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """A model from a bounded sample of labelled rows that are not held out; None without both kinds."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    chosen = chosen.withColumn("fold", F.crc32(F.col("id").cast("string")) % 5).where("fold <> 0")

    # the sample is chosen among the labels, by part: at most ``rows`` ids each, which are broadcast; texts are read once
    part = {name: chosen.where(cond).orderBy(F.xxhash64("id", F.lit(11)), "id", "quality").limit(rows).withColumn("part", F.lit(name)) for name, cond in (("good", "fold <> 4 AND quality = 1"), ("bad", "fold <> 4 AND quality = 0"), ("seen", "fold = 4"), ("any", "true"))}
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).where(F.length("t") <= FIT_CHARS)

    def some(*names: str) -> dict[str, list]:
        ids = reduce(DataFrame.union, [part[n] for n in names])
        found = texts.join(F.broadcast(ids), "id").orderBy("part", "id", "quality").select("part", "t", "quality").collect()
        return {n: [r for r in found if r.part == n] for n in names}

    sample = some("good", "bad", "seen")
    good, bad = ([r.t.encode("utf-8", "surrogatepass") for r in sample[n]] for n in ("good", "bad"))
    if not good or not bad:
        return None
    # both are trained on like amounts of text
    amount = min(sum(map(len, good)), sum(map(len, bad)))
    model = QualityModel(_dictionary(good, amount), _dictionary(bad, amount))
    seen = sample["seen"] if {r.quality for r in sample["seen"]} == {0, 1} else some("any")["any"]
    a, b = model.compressors()
    x, y = np.array([difference(r.t, a, b) for r in seen]), np.array([r.quality for r in seen], float)
    model.x, model.y = isotonic(x, y)
    model.y = np.maximum.accumulate(model.y)
    return model


def _dictionary(samples: list[bytes], amount: int) -> bytes:
    parts, total = [], 0
    for s in samples:
        for i in range(0, len(s), BLOCK):
            if total >= amount and len(parts) >= 8:
                break
            parts.append(s[i : i + BLOCK])
            total += len(parts[-1])
    size = min(DICTIONARY_BYTES, max(1024, total // 4))
    try:
        return zstandard.train_dictionary(size, parts, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content itself serves as a dictionary
        return b"".join(parts)[-size:] or b"\n" * 8


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through the labels: pooled neighbours, as knots at the mean x of each pool."""
    pools: list[list[float]] = []  # sum of x, sum of y, number
    for a, b in zip(*(v[np.argsort(x, kind="stable")] for v in (x, y))):
        pools.append([float(a), float(b), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    n = np.array([p[2] for p in pools])
    # a pool's share is drawn to the middle by one row, so that no score is 0 or 1
    return np.array([p[0] for p in pools]) / n, (np.array([p[1] for p in pools]) + 0.5) / (n + 1)


def _scored(docs: DataFrame, model: QualityModel | None, text_col: str, name: str) -> DataFrame:
    """docs with a column of that name after the others."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        pair = m.compressors() if m else None
        for b in batches:
            texts = strings(b.column(at))
            p = m.probability(np.array([difference(t, *pair) for t in texts])) if m else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], schema=b.schema.append(pa.field(name, pa.float64())))

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """held_out, score and predicted beside the id."""
    out = _scored(docs.select(id_col, text_col), model, text_col, "__score")
    return out.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel | None, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that the model does not reject, with their columns."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return _scored(docs, model, text_col, name).where(F.col(name) >= accept).select(*docs.columns)
