"""Sheets as graph rows and their deletion, targets and manual decisions, batches of chunks and orphans' parents."""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from arborframe.functions.keys import legacy_uid
from arborframe.operators.annotation import annotation_targets, extraction_targets, manual_decisions
from arborframe.operators.navigator import Navigator
from arborframe.operators.sheets import delete_tables, write_sheets
from arborframe.operators.transforms import merge_type, orphan_parents, window_batches
from arborframe.plans.graph import Graph

DOCUMENTS = "key string, tenant_id string, created_by_user_id string, job_id string"
SHEETS = "doc string, sheet_index int, sheet_name string, headers array<string>, theme string, matched_model string, page_id string"
ROWS = "doc string, sheet_index int, row_index bigint, cells array<string>"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def written(spark, rows, documents=(("d", "t", "u", "j"),)):
    sheets = [("d", 0, "One", ["A b", "1c"], None, None, "p"), ("d", 1, "Two", ["x"], "money", "Invoice", ""), ("d", 2, "Empty", ["x"], None, None, None), ("gone", 0, "Lost", ["x"], None, None, None)]
    return write_sheets(spark.createDataFrame(list(documents), DOCUMENTS), spark.createDataFrame(sheets, SHEETS), spark.createDataFrame(rows, ROWS))


CELLS = [("d", 0, 0, ["Élan", None]), ("d", 0, 1, ["elan ", "x" * 600]), ("d", 1, 0, ["7"]), ("gone", 0, 0, ["7"]), ("d", 9, 0, ["no sheet"])]


def test_sheets_become_tables_rows_units_and_results(spark):
    out = written(spark, CELLS)
    nodes = out["structure_node"]
    assert rows_of(nodes.where("role = 'table'"), "id", "title", "theme", "row_count", "column_count", "source_page_ids") == [("d::table_1", "One", "default", 2, 2, ["p"]), ("d::table_2", "Two", "money", 1, 1, []), ("d::table_3", "Empty", "default", 0, 1, [])]
    assert rows_of(nodes.where("role = 'row'"), "id", "parent", "row_index", "appearance_order") == [("d::table_1/row_1", "d::table_1", 0, 1), ("d::table_1/row_2", "d::table_1", 1, 2), ("d::table_2/row_1", "d::table_2", 0, 1)]
    assert out["info_unit"].where("node = 'd::table_1/row_1'").first().description == "| A b | 1c |\n| --- | --- |\n| Élan |  |"
    assert rows_of(out["extraction_result"], "node", "model_class", "source")[2] == ("d::table_2/row_1", "Invoice", None)
    # both spellings are one entity; the long cell is cut
    assert sorted(len(r.value) for r in out["entity"].collect()) == [5, 500]
    links = out["edges"].groupBy("type").count()
    assert dict(rows_of(links, "type", "count")) == {"HAS_STRUCTURE": 3, "HAS_DECISION": 6, "HAS_CHILD": 3, "HAS_INFO_UNIT": 3, "HAS_EXTRACTION": 3, "HAS_A_B": 2, "HAS_COL_1C": 1}
    assert rows_of(out["missing"], "doc", "sheet_index") == [("gone", 0)]
    empty = written(spark, [], documents=())
    assert [empty[t].count() for t in ("structure_node", "info_unit", "extraction_result", "entity", "edges", "missing")] == [0, 0, 0, 0, 0, 4]


def test_deleting_a_table_takes_its_rows_and_instances_but_no_entities(spark):
    made = written(spark, CELLS)
    result = made["extraction_result"].where("node = 'd::table_2/row_1'").first().uid
    more = spark.createDataFrame([("t", result, "HAS_X", "i1"), ("t", "i1", "HAS_Y", "i2"), ("t", "other", "HAS_Y", "i3")], "tenant_id string, src string, type string, dst string")
    tables = {t: made[t] for t in ("structure_node", "info_unit", "model_decision", "extraction_result")}
    tables |= {"edges": made["edges"].union(more), "model_instance": spark.createDataFrame([("i1",), ("i2",), ("i3",)], "uid string")}
    left = delete_tables(tables, spark.createDataFrame([("d::table_2",), ("unknown",), (None,)], "id string"))
    assert rows_of(left["model_instance"], "uid") == [("i3",)]
    assert rows_of(left["structure_node"], "id") == [("d::table_1",), ("d::table_1/row_1",), ("d::table_1/row_2",), ("d::table_3",)]
    assert left["info_unit"].count() == 2 and left["extraction_result"].count() == 2 and left["model_decision"].count() == 2
    assert left["edges"].where("src LIKE '%table_2%' OR dst LIKE '%table_2%' OR src = 'i1'").count() == 0
    assert left["edges"].where("type = 'HAS_A_B'").count() == 2 and left["edges"].where("src = 'other'").count() == 1


def graph(spark):
    frame = spark.createDataFrame
    return Graph(
        {
            "document": frame([("t", "d1", "d1", True), ("t", "d0", "d0", False)], "tenant_id string, key string, path string, latest boolean"),
            "structure_node": frame([("t", "d1", "n1", "One", "Table", 2, None), ("t", "d1", "n2", "Two", "Table", 1, "x"), ("t", "d1", "n3", "No unit", "Table", 3, None), ("t", "d0", "n0", "Old", "Table", 1, None)], "tenant_id string, doc string, id string, title string, role string, appearance_order int, theme string"),
            "info_unit": frame([("t", "u2", "n1", "b", "later", 2), ("t", "u1", "n1", "a", "sooner", 1), ("t", "u3", "n2", "c", None, 1), ("t", "u0", "n0", "o", "old", 1)], "tenant_id string, uid string, node string, title string, description string, order int"),
            "model_decision": frame([("t", "m2", "n2", "Report", "low", None), ("t", "m0", "n0", "Report", "low", None)], "tenant_id string, uid string, node string, matched_model string, confidence string, proposed_model string"),
            "extraction_result": frame([("t", "x2", "n2", "Report", "tabular_raw"), ("t", "x0", "n0", "Report", None)], "tenant_id string, uid string, node string, model_class string, source string"),
            "model_instance": frame([("t", "i1"), ("t", "i2")], "tenant_id string, uid string"),
            "edges": frame([("t", "d1", "HAS_STRUCTURE", "n1"), ("t", "n1", "HAS_CHILD", "n2"), ("t", "n2", "HAS_CHILD", "n3"), ("t", "d0", "HAS_STRUCTURE", "n0"), ("t", "n2", "HAS_DECISION", "m2"), ("t", "n2", "HAS_EXTRACTION", "x2"), ("t", "x2", "HAS_A", "i1"), ("t", "x0", "HAS_A", "i2")], "tenant_id string, src string, type string, dst string"),
        }
    )


def test_targets_are_nodes_with_units_of_latest_documents(spark):
    n = Navigator(graph(spark))
    assert rows_of(annotation_targets(n), "anchor", "node", "theme") == [("d1", "n1", "default"), ("d1", "n2", "x")]
    assert rows_of(annotation_targets(n, only_unannotated=True), "node") == [("n1",)]
    # the one decided node holds a raw result
    assert extraction_targets(n).count() == 0


def test_decisions_by_hand_replace_what_was_there(spark):
    g = graph(spark)
    out = manual_decisions(Navigator(g), "Memo")
    assert rows_of(out["model_decision"], "node", "matched_model") == [("n0", "Report"), ("n1", "Memo"), ("n2", "Memo")]
    uids = {r.uid for r in out["model_decision"].where("source = 'manual'").collect()}
    assert uids == {hashlib.sha256(f"manual_model_decision||{n}||Memo".encode()).hexdigest()[:16] for n in ("n1", "n2")}
    assert rows_of(out["extraction_result"], "uid") == [("x0",)] and rows_of(out["model_instance"], "uid") == [("i2",)]
    assert out["edges"].where("src = 'x2' OR dst IN ('x2', 'm2')").count() == 0 and out["edges"].where("type = 'HAS_DECISION'").count() == 2
    n = Navigator(Graph(g.tables | out))
    notes = spark.createDataFrame([("n1", "Note", "covers"), ("n1", "Note", "covers")], "node string, model_class string, coverage_note string")
    (one, two) = sorted(extraction_targets(n, complementary=notes).collect(), key=lambda r: r.node)
    assert [u.uid for u in one.units] == ["u1", "u2"] and one.matched_model == "Memo"
    assert [c.model_class for c in one.complementary] == ["Note"] and two.complementary == []


def plain_batches(sizes, ceiling):
    """The rule, by a loop."""
    out, batch, used, before = [], 0, 0, 0
    for i, size in enumerate(sizes):
        if i and before + used + size > ceiling:
            batch, before, used = batch + 1, used, 0
        used += size
        out.append(batch)
    return out


def test_batches_keep_under_the_ceiling_with_the_one_before(spark):
    cases = [[], [5], [3, 3, 3, 3, 3], [100, 1, 1, 1], [1, 100, 1], [0, 0, 0], [4, 4, 2, 2, 8, 1]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<int>")
    got = {r.i: r.b for r in df.select("i", window_batches(F.col("c"), 8).alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == [plain_batches(c, 8) for c in cases]


def test_orphans_wait_for_later_batches_and_see_one_batch_back(spark):
    nodes = [
        *[("a", 0, "t0", "Table", 5), ("a", 1, "f1", "Figure", 5), ("a", 2, "s2", "Section", 5), ("a", 3, "t3", "Table", 5), ("a", 4, "t4", "Table", 5)],
        *[("b", 0, "s0", "Section", 2), ("b", 1, "t1", "Table", 2)],
        ("c", 0, "t0", "Table", 1),
    ]
    df = spark.createDataFrame(nodes, "group string, chunk int, id string, role string, size int")

    def decide(asked, pool):
        top = pool.where("role = 'Section'").select("group", F.col("id").alias("parent"))
        # an answer nobody asked for does not count
        return asked.join(top, "group").select("group", "id", "parent").union(top.select("group", F.lit("unasked"), "parent"))

    got = {(r.group, r.id): r.parent for r in orphan_parents(df, decide, 5).collect()}
    assert got == {("a", "t0"): "s2", ("a", "t3"): "s2", ("a", "t4"): None, ("b", "t1"): "s0", ("c", "t0"): None}
    assert orphan_parents(df.where("false"), decide, 5).count() == 0


def test_merge_types_and_uids_without_lengths(spark):
    assert [merge_type(t) for t in (None, StringType(), ArrayType(StringType()), IntegerType(), ArrayType(IntegerType()))] == ["str", "str", "list_str", "other", "other"]
    assert spark.range(1).select(legacy_uid(F.lit("a"), F.lit("b"))).first()[0] == hashlib.sha256(b"a||b").hexdigest()[:16]
