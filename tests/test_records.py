"""Catalogue, writing records, office files, images and the newer lifecycle operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from arborframe.operators.lifecycle import freeze, restore_plan, restored_edges, sweep
from arborframe.operators.navigator import Navigator
from arborframe.operators.records import instance_rows, instantiate, keyed_links, source_values, upsert, with_shells, write_triples
from arborframe.operators.transforms import active_branch, best_theme, compact_parents, output_parts
from arborframe.plans.catalogue import SAMPLE, Catalogue, Model, parse_type, snake_case
from arborframe.plans.graph import SampleGraph
from arborframe.sources.media import find_in_transcript, page_windows, select_images
from arborframe.sources.office import docx_pages, pptx_pages, read_pages, read_xlsx, table_markdown, xlsx_rows
from arborframe.sources.registry import Registry, dry_run, originals, store_pages, stored_pages

SF = "/root/testdata/sf0.001"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return zipped({"word/document.xml": f"<w:document {ns}><w:body>{''.join(paragraphs)}</w:body></w:document>"})


def paragraph(text, style="", more=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t>{more}</w:r></w:p>'


RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx():
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{OFFICE}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{RELATIONS}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c><c r="D3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
        }
    )


def test_text_documents_break_into_pages():
    data = docx(paragraph("Top", "Heading2"), paragraph("a", more='<w:br w:type="page"/>'), *(paragraph(str(i)) for i in range(5)), paragraph(""))
    assert docx_pages(data) == ["## Top\n\na", "0\n\n1\n\n2\n\n3", "4"]
    assert docx_pages(docx()) == [""]
    assert table_markdown([["a", "b|c"], ["d"]]) == "| a | b\\|c |\n| --- | --- |\n| d |  |" and table_markdown([]) == ""


def test_slides_follow_the_presentation():
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    slide = lambda title, text: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:p><a:t>{title}</a:t></a:p></p:sp><p:grpSp><p:sp><a:p><a:t>{text}</a:t></a:p></p:sp></p:grpSp></p:sld>'
    data = zipped(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" xmlns:r="{OFFICE}"><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{RELATIONS}"><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
            "ppt/slides/slide1.xml": slide("One", "x"),
            "ppt/slides/slide2.xml": slide("Two", "y"),
        }
    )
    assert pptx_pages(data) == ["# Two\n\ny", "# One\n\nx"]


def test_sheets_keep_columns_and_row_numbers():
    assert list(xlsx_rows(xlsx())) == [("One", 0, ["name", "", "two runs"]), ("One", 2, ["", "True", "2.5", "x"])]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, data in {"a.docx": docx(paragraph("x")), "sub/broken.docx": b"no zip", "b.xlsx": xlsx(), "c.txt": b"one\ntwo", "d.html": b"<h1>T</h1><p>u", "e.bin": b"\0"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    folder = str(tmp_path / "in")
    rows = read_pages(spark, folder, "docx").collect()
    assert sorted((r.markdown, bool(r.error)) for r in rows if r.error is None) == [("x", False)] and [r.page for r in rows if r.error] == [None]
    assert [(r.sheet, r.row_index) for r in read_xlsx(spark, folder, batch=1).collect()] == [("One", 0), ("One", 2)]
    assert {(r.kind, r.extension): r.files for r in dry_run(spark, folder).collect()} == {("convertible", "docx"): 2, ("tabular", "xlsx"): 1, ("convertible", "txt"): 1, ("convertible", "html"): 1, ("skipped", "bin"): 1}
    pages = Registry().read(spark, folder, ["txt", "html", "docx"])
    store_pages(pages, str(tmp_path / "pages"))
    assert [r.markdown for r in stored_pages(spark, str(tmp_path / "pages")).collect()] == ["x", "one\ntwo", "# T\n\nu"]
    assert originals(spark, folder).where("path LIKE '%c.txt'").first()["size"] == 7


def test_windows_cover_all_pages():
    size = lambda s, e: (e - s) * (30 if s < 4 else 5)
    got = list(page_windows(10, 100, size, 5, 60))
    assert [p for s, e in got for p in range(s, e)] == list(range(10)) and all(size(s, e) <= 60 and e - s <= 5 for s, e in got)
    with pytest.raises(ValueError):
        list(page_windows(3, 100, lambda s, e: 99, 5, 60))
    assert list(page_windows(0, 0, size)) == []


def test_images_and_transcripts(spark):
    rows = [("d", 0, 0, 100, 100, b"a"), ("d", 0, 1, 300, 100, b"b"), ("d", 0, 2, 10, 900, b"c"), ("d", 1, 0, 100, 100, b"a"), ("d", 1, 1, 64, 64, b"e"), ("d", 0, 3, 90, 90, b"f")]
    df = spark.createDataFrame(rows, "document string, page int, index int, width int, height int, content binary")
    assert sorted((r["page"], r["index"]) for r in select_images(df, "document", per_page=2).collect()) == [(0, 0), (0, 1), (1, 1)]
    # one place twice: the larger of equal bytes, whatever comes first; rows are told apart by their width
    for rows in ([("d", 0, 1, 70, 90, b"a"), ("d", 0, 1, 80, 90, b"a"), ("d", 0, 2, 75, 90, b"b")], [("d", 0, 3, 70, 90, b"x"), ("d", 0, 3, 90, 70, b"y")]):
        got = [[r["width"] for r in select_images(spark.createDataFrame(x, df.schema).coalesce(1), "document", per_page=1).collect()] for x in (rows, rows[::-1])]
        assert got == [[max(r[3] for r in rows)]] * 2
    cues = spark.createDataFrame([([("The  Big\nword",), ("no",)],)], "cues array<struct<text:string>>")
    assert cues.select(F.size(find_in_transcript(F.col("cues"), " big WORD ")), F.size(find_in_transcript(F.col("cues"), " "))).first()[:] == (1, 0)


def test_catalogue(spark):
    assert snake_case("HTTPServerModel") == "http_server_model"
    assert parse_type("Optional[dict[str, list[int]]]").simpleString() == "map<string,array<bigint>>" and parse_type("Weird[x]").simpleString() == "string" and parse_type("int | None").simpleString() == "bigint"
    assert SAMPLE.reachable(["Report", "Absent"]) == ["Report", "Region", "Nation", "Customer", "Order"]
    circle = Catalogue([Model("A", {"b": "B"}), Model("B", {"a": "list[A]", "n": "int"})])
    assert circle.schema("A").simpleString() == "struct<b:struct<a:array<string>,n:bigint>>"
    assert circle.composed("B", ["A"], [("extra", "list[str]"), ("b", "int")]).fieldNames() == ["b", "a", "extra"]
    assert {(r.path, r.parent) for r in SAMPLE.themes(spark).collect()} == {("trade", None), ("trade/places", "trade"), ("trade/sales", "trade"), ("general", None)}


def test_nested_records_become_rows(spark):
    df = spark.createDataFrame([("1", ("x", None, [("p", 1), None, ("q", None)])), ("2", None), ("3", (None, (5,), None))], "uid string, r struct<name:string,one:struct<k:int>,many:array<struct<a:string,b:int>>>")
    out = instance_rows(df, "M", "r")
    assert sorted((r.model_class, tuple(sorted(r.props.items()))) for r in out["nodes"].collect()) == [("M", ()), ("M", (("name", "x"),)), ("M.many", (("a", "p"), ("b", "1"))), ("M.many", (("a", "q"),)), ("M.one", (("k", "5"),))]
    assert sorted((r.src, r.type) for r in out["edges"].collect()) == [("1", "HAS_MANY"), ("1", "HAS_MANY"), ("3", "HAS_ONE")]
    assert instance_rows(df, "M", "r", depth=1)["edges"].count() == 0
    assert instance_rows(df.where("false"), "M", "r")["nodes"].count() == 0


def test_keyed_links_make_shells(spark):
    df = spark.createDataFrame([("a", ["1", " 1", None, "2"], "t", "de"), ("b", ["3"], " ", "de"), ("c", None, "t", "de")], "uid string, ids array<string>, fixed string, tenant string")
    out = keyed_links(df, "uid", "ids", "T", "id", {"kind": "fixed"}, "NEEDS", "tenant")
    assert out["edges"].count() == 2 and {r.src for r in out["edges"].collect()} == {"a"}
    shell = out["shells"].orderBy("props.id").collect()
    assert [r.props for r in shell] == [{"id": "1", "kind": "t"}, {"id": "2", "kind": "t"}]
    real = spark.createDataFrame([(shell[0].uid, "T", {"id": "1", "name": "n"})], "uid string, model_class string, props map<string,string>")
    assert sorted(len(r.props) for r in with_shells(real, out["shells"]).collect()) == [2, 2] and with_shells(real, out["shells"]).count() == 2


def test_triples_and_rows(spark):
    t = spark.createDataFrame([("Ann", "works at", "Acme", 1), ("ANN ", "Works  At", "acme", 2), ("Bob", None, "x", 3), ("Bob", "p", " ", 4)], "subject string, predicate string, object string, seq int")
    out = write_triples(t)
    assert sorted(r.value for r in out["entities"].collect()) == ["Acme", "Ann"]
    assert [(r.type, r.predicate) for r in out["edges"].collect()] == [("WORKS_AT", "works at")]
    df = spark.createDataFrame([(1, "7", ""), (2, "x", None)], "id int, n string, note string")
    assert [r.record and r.record.n for r in instantiate(df, {"n": "int"}).orderBy("id").collect()] == [7, None]
    assert [(r.id, r.field) for r in source_values(df, "id", ["n", "note"]).orderBy("id").collect()] == [(1, "n"), (2, "n")]
    assert sorted(r[:] for r in upsert(df, df.where("id = 2").withColumn("n", F.lit("y")), ["id"]).collect() if r.id == 2) == [(2, "y", None)]


def test_structuring(spark):
    n = spark.createDataFrame([("d", "s", "Section", "x", None, 1), ("d", "s_1", "Block", "nowhere", "s", 2), ("d", "s_1_a", "Block", "s", "s_1", 3)], "doc string, id string, role string, parent_id string, parent string, seq int")
    assert {r.id: r.parent for r in compact_parents(n, "doc").collect()} == {"s": None, "s_1": "s", "s_1_a": "s"}
    assert [(r.id, r.level) for r in active_branch(n, "doc", "seq", "parent").orderBy("level").collect()] == [("s_1_a", 0), ("s_1", 1), ("s", 2)]
    themes = spark.createDataFrame([("a",), ("a/b",)], "theme string")
    asked = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",), (None,)], "detected string")
    assert {r.detected: r.theme for r in best_theme(asked, "detected", themes).collect()} == {"a/b/c": "a/b", "a/x": "a", "z": "default", None: "default"}
    assert output_parts([], 5) == [] and output_parts([1, 1], 5) == [(0, 2)] and output_parts([4, 4, 4], 5) == [(0, 1), (1, 2), (2, 3)]


def test_lifecycle(spark):
    n = Navigator(SampleGraph(spark, SF))
    seeds = n.table("document").where("job_id = 'src0'").limit(3)
    out = freeze(n, seeds, "s1", keep=("info_unit",))
    assert out["document"].where("snapshot_id = 's1'").count() == 3 and out["document"].count() == n.table("document").count()
    assert out["info_unit"].count() == n.table("info_unit").count() and out["structure_node"].count() < n.table("structure_node").count()
    have = spark.createDataFrame([("a", "s1"), ("b", None), ("c", "s2")], "key string, snapshot_id string")
    wanted = spark.createDataFrame([(k, "s1") for k in "abcd"], "document string, snapshot_id string")
    assert {r.document: r.action for r in restore_plan(wanted, have).collect()} == {"a": "refill", "b": "refuse", "c": "refuse", "d": "recreate"}
    e = spark.createDataFrame([("a", "T", "b"), ("a", "T", "b"), ("b", "T", "c")], "src string, type string, dst string")
    assert restored_edges(e.where("src = 'b'"), e).count() == 2
    i = spark.createDataFrame([("i1",), ("i2",)], "uid string")
    links = spark.createDataFrame([("r", "HAS_X", "i1"), ("i2", "REFERENCES", "e")], "src string, type string, dst string")
    gone = sweep(i, spark.createDataFrame([("e",)], "uid string"), spark.createDataFrame([("r",)], "uid string"), links, 2)
    assert [r.uid for r in gone["model_instance"].collect()] == ["i2"] and gone["labeled_entity"].count() == 1


def test_stored_sources(spark):
    n = Navigator(SampleGraph(spark, SF))
    wanted = spark.createDataFrame([(n.table("structure_node").first()["id"],), ("absent",)], "id string")
    out = n.get_structure_nodes_source_pages(wanted)
    assert [r.id for r in out["missing"].collect()] == ["absent"] and out["nodes"].count() == 1 and out["pages"].count() == 1
    one = n.get_document_images().first()
    assert n.get_page_image(one.anchor, one.page_index, one.image_index).first()["content"]
    with pytest.raises(ValueError):
        n.get_model_instance_by_key(wanted, "Customer", ["id"])
