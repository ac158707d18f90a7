"""The pipeline's stages against brute force, on rows with null and repeated ids."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from arborframe.llm import packing, pii
from arborframe.llm.queries import vocabulary

R = random.Random(9)
WORDS = ["".join(R.choices("abcde", k=R.randint(2, 7))) for _ in range(200)]
SCHEMA = "doc_id long, text string, lang string"


def text(n=60):
    return " ".join(R.choices(WORDS, k=n))


def near(t):
    return t + " zz"


def rows():
    a, b, c, d = (text() for _ in range(4))
    base = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, d), (None, None), (9, ""), (9, " "), (9, "\t "), (8, d + " "), (8, text())]
    close = [text() for _ in range(12)]
    base += [(20 + i, t) for i, t in enumerate(close)] + [(30 + i, near(t)) for i, t in enumerate(close)] + [(None, near(close[0])), (None, text()), (31, text()), (None, near(near(b)))]
    # groups of rows that have null ids only, and repeats of whole rows
    return base + [(None, f"{a} {c}"), (None, f"{a} {c}"), (3, a), (20, close[0])]


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def exact(found):
    """What stays: rows with the least id of their normalised text."""
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    return [(i, t) for i, t in found if i == least(j for j, u in found if norm(u) == norm(t))]


def close_sets(found, size=5, num=80, den=100):
    """What stays: rows with the least id of their component."""
    sets = []
    for _, t in found:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(found)))
    for x in range(len(found)):
        for y in range(x):
            if sets[x] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                comp = [comp[y] if c == comp[x] else c for c in comp]
    return [r for k, r in enumerate(found) if not sets[k] or r[0] == least(found[j][0] for j in range(len(found)) if comp[j] == comp[k])]


def frame(spark, found):
    return spark.createDataFrame([(i, t, "en") for i, t in found], SCHEMA)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_dedup_stages_drop_rows_not_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(corpus_pipeline, "FEW_ROWS", bound)
    found = rows()
    after = exact(found)
    assert pairs(corpus_pipeline.drop_copies(spark, frame(spark, found), "")) == Counter(after)
    for given in (found, after):
        assert pairs(corpus_pipeline.drop_near_copies(spark, frame(spark, given), "")) == Counter(close_sets(given))
    # the documents that dropping by id lost
    assert sum(i == 5 for i, _ in after) == 1 and sum(i is None for i, _ in close_sets(after)) > 2


def test_pipeline_against_brute_force(spark, tmp_path):
    found = [(i, t if n % 3 else f"{t} mail a@b.example.com") for n, (i, t) in enumerate(rows())]
    frame(spark, found).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # without labels the classifier keeps every document
    left = close_sets(exact(found))
    masked = [(i, t and pii.masked(t, [x for part in pii._found([t], pii.trained())[0] for x in part])) for i, t in left]
    want = packing.pack(frame(spark, masked), vocabulary())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    count = lambda df: Counter(tuple(r) for r in df.select(*columns).collect())
    assert any("<email>" in (t or "") for _, t in masked)
    assert count(corpus_pipeline.run(spark, str(tmp_path))) == count(want)
