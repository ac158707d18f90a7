import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborframe.functions.keys import edge_type, instance_uid, normalize_key, redact
from arborframe.functions.predicates import Op, where
from arborframe.functions.scope import Scope
from arborframe.operators import navigator, traverse
from arborframe.operators.navigator import Navigator
from arborframe.operators.transforms import assemble_tree, merge_siblings, merge_values, prefix_parents
from arborframe.plans.graph import Graph
from arborframe.sources.tabular import header, read_csv, sniff
from arborframe.sources.text import segments, to_markdown

SF = "/root/testdata/sf0.001"


def test_golden_uids(spark):
    """The uids of three countries of the public tenant."""
    df = spark.createDataFrame([("be",), ("cy",), ("at",)], "c string").select("c", instance_uid("Country", {"country_code": F.col("c")}).alias("u"))
    assert {r.c: r.u for r in df.collect()} == {"be": "1ea4048d299f6e72", "cy": "daa2d84b6a028373", "at": "0abf952cf358f276"}


def test_keys(spark):
    df = spark.createDataFrame([("  Q.I.A.1(A) ",), ("Málaga",), ("a   b\tc",), (None,)], "v string").select(normalize_key(F.col("v")).alias("k"), edge_type(F.col("v")).alias("e"))
    rows = df.collect()
    assert [r.k for r in rows] == ["q.i.a.1(a)", "malaga", "a b c", None]
    assert [r.e for r in rows] == ["Q_I_A_1_A", "MALAGA", "A_B_C", "RELATED_TO"]
    assert spark.range(1).select(redact(F.lit("bolt://u:secret@h")).alias("x")).first().x == "bolt://u:***@h"


def test_predicates(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "xabc")], "n int, s string")
    ids = lambda c: sorted(r.n for r in where(df, c).collect())
    assert ids({"s": None}) == []
    assert ids({"s": Op("not_in", ["abc"])}) == [3]
    assert ids({"s": Op("regex", "abc")}) == [1]
    assert ids({"s": Op("contains", "abc"), "n": Op("gt", 1)}) == [3]
    assert ids({"s": Op("is_null")}) == [2]
    with pytest.raises(ValueError):
        where(df, {"n; drop": 1})
    with pytest.raises(ValueError):
        Op("like", "a")


def test_scope(spark):
    with pytest.raises(ValueError):
        Scope(tenant_id="")
    with pytest.raises(ValueError):
        Scope(users=[])
    with pytest.raises(ValueError):
        Scope(tenant_id="a").narrowed(tenant_id="b")
    df = spark.createDataFrame([("a", ["j1"]), ("__public__", None), ("b", ["j1"])], "tenant_id string, job_ids array<string>")
    assert Scope("a", include_public=True).all(df).count() == 2
    assert Scope("a", include_public=True, jobs=["j1"]).all(df).count() == 1


def test_walks_against_an_evaluator(spark):
    r = random.Random(3)
    edges = sorted({(f"n{r.randrange(7)}", f"t{r.randrange(2)}", f"n{r.randrange(7)}") for _ in range(14)})
    df = spark.createDataFrame(edges, "src string, type string, dst string")
    start = spark.createDataFrame([("n0",), ("n1",)], "anchor string")

    def trails(at, depth, used, both):
        for e in edges:
            for a, b in ((e[0], e[2]), (e[2], e[0])) if both else ((e[0], e[2]),):
                if a == at and e not in used and depth:
                    yield b, len(used) + 1
                    yield from trails(b, depth - 1, (*used, e), both)

    for both in (False, True):
        got = {(x.anchor, x.node, x.depth) for x in traverse.paths(start, df, 3, both).collect()}
        assert got == {(a, n, d) for a in ("n0", "n1") for n, d in trails(a, 3, (), both)}
    got = {(x.anchor, x.node): x.depth for x in traverse.walk(start, df, 3).collect()}
    want = {}
    for a in ("n0", "n1"):
        for n, d in trails(a, 3, (), False):
            want[a, n] = min(d, want.get((a, n), 9))
    assert got == want
    for bad in (0, True, "3"):
        with pytest.raises(ValueError):
            traverse.check_depth(bad)


#: What merging lists of cell values gives.
MERGES = [
    (["Amox 500 mg", "500 mg", "mg"], ["Amox 500 mg"]),
    (["mg", "500 mg", "Amox 500 mg"], ["Amox 500 mg"]),
    (["Madrid", "MADRID "], ["Madrid"]),
    (["Amoxicillin", "Paracetamol"], ["Amoxicillin", "Paracetamol"]),
    (["", "  ", "X"], ["X"]),
    (["", " "], []),
    (["Amox 500 mg", "mg 500"], ["Amox 500 mg"]),
    (["Amox   500\tmg", "amox 500"], ["Amox   500\tmg"]),
    (["\tX\n", "x"], ["X"]),
]


def test_merge_values(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MERGES)], "i int, v array<string>").select("i", merge_values(F.col("v")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == [b for _, b in MERGES]


def test_structuring(spark):
    ids = spark.createDataFrame([(1, x) for x in ("a", "a_b", "a_b_c", "a_x-y", "q_r")], "g int, id string")
    assert {r.id: r.parent for r in prefix_parents(ids, "g", "id").collect()} == {"a": None, "a_b": "a", "a_b_c": "a_b", "a_x-y": None, "q_r": None}
    nodes = spark.createDataFrame([("r", None, False), ("a", None, True), ("b", None, True), ("c", None, True), ("d", None, True), ("k", "r", False)], "id string, parent string, is_orphan boolean")
    decided = spark.createDataFrame([("a", "r", 1), ("a", "b", 2), ("b", "c", 1), ("c", "b", 1), ("d", "nowhere", 1), ("k", "a", 1)], "id string, parent string, seq int")
    assert {r.id: r.parent for r in assemble_tree(nodes, decided).collect()} == {"r": None, "a": "r", "b": None, "c": None, "d": None, "k": "r"}
    sib = spark.createDataFrame([("p", "x", "T1", [1], "general", 1), ("p", "x", "T2", [2, 1], "legal", 2)], "parent string, id string, title string, pages array<int>, theme string, ord int")
    row = merge_siblings(sib, ["parent", "id"], "ord").first()
    assert (row.title, row.pages, row.theme) == ("T1", [1, 2], "legal")


def test_tables(spark, tmp_path):
    assert [sniff(x) for x in ("a,b\n1,2", "a;b\n1;2", "a\tb\n1\t2", "")] == [",", ";", "\t", ","]
    assert header(["a", "a", " b ", "", "a"]) == ["a", "a_2", "b", "column_4", "a_3"]
    (tmp_path / "t.csv").write_text('﻿id;note\n1;"x\ny"\n;\n2;z;9\n3\n', encoding="utf-8")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["row_index", "id", "note"]
    assert [(r.id, r.note) for r in df.orderBy("row_index").collect()] == [("1", "x\ny"), ("2", "z"), ("3", "")]


def test_headers_are_parsed(spark, tmp_path):
    for name, text, columns, cells in (("q", '"a, x",b\n1,2\n', ["a, x", "b"], ["1", "2"]), ("blank", "\n" * 25 + "a;b\n1;2\n", ["a", "b"], ["1", "2"]), ("line", '"a\nz",b\n"1,5",2\n', ["a\nz", "b"], ["1,5", "2"])):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
        df = read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["row_index", *columns] and [list(r)[1:] for r in df.collect()] == [cells]
    (tmp_path / "nul.csv").write_text("a,b\n" + "1,2\n" * 50 + "1,\0\n", encoding="utf-8")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "nul.csv"))


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><nav>n</nav><h1>A</h1><p>x <b>y</b></p><ul><li>1<ol><li>2</li></ol></li></ul><table><tr><th>a</th></tr><tr><td>1|2</td><td>3</td></tr></table><script>s</script></body></html>"
    assert to_markdown(html) == "# A\n\nx y\n\n- 1\n\n  1. 2\n\n| a |  |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert to_markdown(None) == ""
    cut = lambda d, step=300_000, least=10_000: [(x.start_ms, x.end_ms) for x in spark.range(1).select(segments(F.lit(d).cast("long"), step, least).alias("s")).first().s]
    assert cut(300_050) == [(0, 290_000), (290_000, 300_050)]
    assert cut(700_000) == [(0, 300_000), (300_000, 600_000), (600_000, 700_000)]
    assert cut(300_000) == [(0, 300_000)] and cut(10) == [(0, 10)] and cut(0) == [(0, 0)]
    # a least piece of more than half a step counts as half a step
    assert cut(11_000, 10_000, 9_000) == [(0, 6_000), (6_000, 11_000)]


def test_paths_and_long_circles(spark):
    e = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("a", "S", "d"), ("d", "S", "c"), ("c", "R", "e"), ("x", "R", "y")], "src string, type string, dst string")
    start, to = spark.createDataFrame([("a",)], "anchor string"), spark.createDataFrame([("e",), ("y",), ("d",)], "node string")
    got = {r.node: (r.hops, r.path, r.types) for r in traverse.shortest_paths(start, to, e).collect()}
    assert got == {"e": (3, ["a", "b", "c", "e"], ["R", "R", "R"]), "d": (1, ["a", "d"], ["S"])}
    assert traverse.shortest_paths(start, to, e, 2).count() == 1
    # a circle of 25, a chain of 40 that leads into it, and a chain that ends
    n = 25
    nodes = [(f"c{i}", None, True) for i in range(n)] + [(f"l{i}", None, True) for i in range(40)] + [(f"k{i}", None, True) for i in range(30)] + [("root", None, False)]
    decided = [(f"c{i}", f"c{(i + 1) % n}", 1) for i in range(n)] + [(f"l{i}", f"l{i + 1}" if i < 39 else "c3", 1) for i in range(40)] + [(f"k{i}", f"k{i + 1}" if i < 29 else "root", 1) for i in range(30)]
    got = {r.id: r.parent for r in assemble_tree(spark.createDataFrame(nodes, "id string, parent string, is_orphan boolean"), spark.createDataFrame(decided, "id string, parent string, seq int")).collect()}
    assert got == {k: (None if k.startswith("c") else p) for k, p, _ in decided} | {"root": None}


def test_raw_queries_are_guarded(spark):
    n = Navigator(None)
    assert n.execute_raw(spark, "SELECT 'drop' AS a -- delete\n").first().a == "drop"
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM t", "INSERT INTO t SELECT 1"):
        with pytest.raises(PermissionError):
            n.execute_raw(spark, bad)
    with pytest.raises(PermissionError):
        Navigator(None, Scope("a")).execute_raw(spark, "SELECT 1")


def same(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda rows: sorted((repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert key([[r[c] for c in cols] for r in df.collect()]) == key(want)


@pytest.mark.parametrize("name", ["folder_overview", "get_document_tree", "get_sibling_nodes", "get_annotation_coverage", "get_outgoing_model_instances", "get_documents_scoped", "search_info_units", "route_rows", "merge_entities", "delete_cascade"])
def test_queries_equal_their_sql(spark, name):
    same(spark, name)


def test_streamed_progress(spark, tmp_path):
    from arborframe.streaming.progress import fold, read_events

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = fold(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("progress_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM progress_counts").first().n == spark.read.parquet(f"{SF}/events.parquet").count()


def test_products_hold_each_pair_once(spark, monkeypatch):
    """Sets of any size, over many blocks; an owner without rows and rows without an owner stay out."""
    monkeypatch.setattr(navigator, "OWNERS", 3)
    monkeypatch.setattr(navigator, "ITEMS", 4)
    owners = [(f"o{i}", f"s{i % 2}") for i in range(25)] + [("alone", "s8")]
    items = [(f"s{i % 2}", f"n{i}", i) for i in range(31)] + [("s9", "n", 0)]
    df = navigator.product(spark.createDataFrame(owners, "anchor string, held string"), spark.createDataFrame(items, "held string, node string, depth int"))
    assert df.columns == ["anchor", "node", "depth"]
    assert sorted(r[:] for r in df.collect()) == sorted((o, n, d) for o, s in owners for t, n, d in items if s == t)


def _rows_made_last(df):
    """Nothing is sorted, joined or made distinct after the product's rows are made."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return next(x for x in plan if not x.lstrip(" +-:").startswith("Project")).lstrip(" +-:").startswith("Generate")


@pytest.fixture(scope="module")
def shared(spark):
    """Two results of a node, one of another; A and B hold C both, A also by way of B."""
    frame = lambda rows, schema: spark.createDataFrame([("t", *r) for r in rows], "tenant_id string, " + schema)
    edges = [("d", "HAS_STRUCTURE", "n1"), ("n1", "HAS_CHILD", "n2"), ("e", "HAS_STRUCTURE", "n3"), ("x1", "HAS_A", "A"), ("x2", "HAS_B", "B"), ("x3", "HAS_B", "B"), ("A", "HAS_B", "B"), ("A", "HAS_C", "C"), ("B", "HAS_C", "C")]
    return Navigator(Graph({
        "document": frame([("d", "d"), ("e", "e"), ("f", "f")], "key string, path string"),
        "extraction_result": frame([("x1", "n2", "M"), ("x2", "n2", "M"), ("x3", "n3", "M")], "uid string, node string, model_class string"),
        "model_instance": frame([("A", "K"), ("B", "K"), ("C", "L")], "uid string, model_class string").withColumn("props", F.create_map(F.lit("a"), F.lit("b"))),
        "edges": frame(edges, "src string, type string, dst string"),
    }))


def test_instances_of_documents(shared):
    df = shared.get_document_model_instances()
    assert sorted(r[:] for r in df.collect()) == [("d", "A", "K"), ("d", "B", "K"), ("d", "C", "L"), ("e", "B", "K"), ("e", "C", "L")]
    assert _rows_made_last(df)
    known = Navigator(shared.graph)
    known.nodes_of_documents()
    assert sorted(r[:] for r in known.get_document_model_instances().collect()) == sorted(r[:] for r in df.collect())


def test_documents_of_instances(shared):
    df = shared.get_documents_for_model_instance()
    assert sorted(r[:] for r in df.collect()) == [("A", "d"), ("B", "d"), ("B", "e"), ("C", "d"), ("C", "e")]
    assert _rows_made_last(df)


def test_results_of_instances(shared):
    df = shared.get_extraction_results_for_model_instance()
    assert sorted(r[:] for r in df.collect()) == [("A", "x1"), ("B", "x1"), ("B", "x2"), ("B", "x3"), ("C", "x1"), ("C", "x2"), ("C", "x3")]
    assert _rows_made_last(df)
    assert {(r.node, r.depth) for r in shared.contained(anchors=["x1"]).collect()} == {("A", 1), ("B", 2), ("C", 2)}


def test_nodes_of_instances(shared):
    """hops are the least over the results of a node."""
    df = shared.get_structure_nodes_for_model_instance()
    assert sorted(r[:] for r in df.collect()) == [("A", "n2", 1), ("B", "n2", 1), ("B", "n3", 1), ("C", "n2", 2), ("C", "n3", 2)]
    assert _rows_made_last(df)


def test_instances_of_nodes(shared):
    df = shared.get_node_model_instances()
    assert sorted(r[:] for r in df.collect()) == [("n2", "A", "K"), ("n2", "B", "K"), ("n2", "C", "L"), ("n3", "B", "K"), ("n3", "C", "L")]
    assert _rows_made_last(df)
    assert sorted(r[:] for r in shared.get_node_model_instances(direct_only=True).collect()) == [("n2", "A", "K"), ("n2", "B", "K"), ("n3", "B", "K")]


@pytest.fixture(scope="module")
def crowded(spark):
    """3,000 documents, each with a node and a result, all of which hold A, and by it B."""
    n = spark.range(3000)
    edge = lambda src, kind, dst: n.select(F.lit("t").alias("tenant_id"), src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    d, node, x = (F.concat(F.lit(c), F.col("id").cast("string")) for c in "dnx")
    inside = spark.createDataFrame([("t", "A", "HAS_B", "B")], "tenant_id string, src string, type string, dst string")
    return Graph({
        "document": n.select(F.lit("t").alias("tenant_id"), d.alias("key"), d.alias("path")),
        "extraction_result": n.select(F.lit("t").alias("tenant_id"), x.alias("uid"), node.alias("node"), F.lit("M").alias("model_class")),
        "model_instance": spark.createDataFrame([("t", "A", "K"), ("t", "B", "L")], "tenant_id string, uid string, model_class string").withColumn("props", F.create_map(F.lit("a"), F.lit("b"))),
        "edges": edge(d, "HAS_STRUCTURE", node).union(edge(x, "HAS_A", F.lit("A"))).union(inside),
    })


@pytest.mark.parametrize("name", ["get_document_model_instances", "get_extraction_results_for_model_instance", "get_structure_nodes_for_model_instance", "get_documents_for_model_instance", "get_node_model_instances"])
def test_few_copies_are_shuffled(crowded, monkeypatch, name):
    """What a set holds is shuffled at most 4 times, its owners at most 64 times, while blocks are not full."""
    pairs, made = [], navigator._pairs
    monkeypatch.setattr(navigator, "_pairs", lambda *a: pairs.append(made(*a)) or pairs[-1])
    assert getattr(Navigator(crowded), name)().distinct().count() == 6000
    assert pairs[0].groupBy("held", "_i").count().agg(F.max("count")).first()[0] <= 4
    assert pairs[0].groupBy("held", "_o").count().agg(F.max("count")).first()[0] <= 64
