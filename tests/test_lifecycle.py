"""Freezing, deleting and resolving folders whose documents and nodes lie deep."""

import pytest

from arborframe.operators import traverse
from arborframe.operators.lifecycle import delete_cascade, freeze, leaves_or_self, restore, snapshot
from arborframe.operators.navigator import Navigator
from arborframe.plans.graph import Graph

DEEP = 13
LABELS = {"document": ("Document", "key"), "structure_node": ("StructureNode", "id"), "info_unit": ("InfoUnit", "uid"), "model_decision": ("ModelDecision", "uid"), "extraction_result": ("ExtractionResult", "uid")}


@pytest.fixture(scope="module")
def nav(spark):
    """Folders d0 / d1 / ... / d13, of which each has a chain of as many nodes, and a document apart from them."""
    docs = [f"d{i}" for i in range(DEEP + 1)] + ["other"]
    nodes = [(d, f"{d}.n{k}") for d in docs for k in range(6)]
    edges = [(f"d{i}", "IS_COMPOSED_OF", f"d{i + 1}") for i in range(DEEP)] + [(d, "HAS_STRUCTURE", f"{d}.n0") for d in docs] + [(f"{d}.n{k}", "HAS_CHILD", f"{d}.n{k + 1}") for d in docs for k in range(5)]
    hang = lambda mark: spark.createDataFrame([("t", f"{n}.{mark}", n) for _, n in nodes], "tenant_id string, uid string, node string")
    tables = {"document": spark.createDataFrame([("t", d) for d in docs], "tenant_id string, key string"), "structure_node": spark.createDataFrame([("t", n) for _, n in nodes], "tenant_id string, id string"), "edges": spark.createDataFrame([("t", *e) for e in edges], "tenant_id string, src string, type string, dst string")}
    return Navigator(Graph(tables | {"info_unit": hang("u"), "model_decision": hang("d"), "extraction_result": hang("x")}))


def keys(tables):
    return {(label, r[key]) for t, (label, key) in LABELS.items() for r in tables[t].select(key).collect()}


def test_freeze_of_a_folder_exports_what_it_removes(spark, nav):
    seeds = nav.table("document").where("key = 'd0'")
    whole = keys({t: nav.table(t) for t in LABELS})
    out = freeze(nav, seeds, "s1")
    held = [(r.label, r.key) for r in out["snapshot"].collect()]
    left = keys(out)
    assert len(held) == len(set(held)) and whole - left <= set(held)
    assert set(held) == {x for x in whole if not x[1].startswith("other")}
    assert {r.key for r in out["document"].where("snapshot_id = 's1'").collect()} == {f"d{i}" for i in range(DEEP + 1)}
    existing = spark.createDataFrame(sorted(left), "label string, key string")
    back = [(r.label, r.key) for r in restore(existing, out["snapshot"]).collect()]
    assert len(back) == len(whole) and set(back) == whole


def test_cascade_and_snapshot_reach_any_depth(nav):
    seeds = nav.table("document").where("key IN ('d0', 'd1')")
    left = keys(delete_cascade(nav, seeds))
    assert left == {x for x in keys({t: nav.table(t) for t in LABELS}) if x[1].startswith("other")}
    assert snapshot(nav, nav.table("document").where("key = 'd13'")).count() == 1 + 4 * 6


def test_leaves_at_any_depth_and_in_circles(spark, nav):
    found = {(r.anchor, r.leaf) for r in leaves_or_self(nav.table("document"), nav.edges("IS_COMPOSED_OF")).collect()}
    assert found == {(f"d{i}", f"d{DEEP}") for i in range(DEEP + 1)} | {("other", "other")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "anchor string")
    assert {(r.node, r.depth) for r in traverse.closure(start, ring).collect()} == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert traverse.closure(start, ring.where("false")).count() == 0
