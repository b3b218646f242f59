"""Readers, sinks and source adapters."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gradeworks.sources import adapters, records, shapes

SCHEMA = "sample_id string, n int"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sample_id": "x", "n": 1}\n\n{"sample_id": "", "n": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"sample_id": "y", "n": 3}\nbroken\n')
    return tmp_path


def test_readers(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert records.read_strict(spark, f"{folder}/a.jsonl", schema).count() == 2
    with pytest.raises(Exception):
        records.read_strict(spark, f"{folder}/b.jsonl", schema).collect()
    assert [r["sample_id"] for r in records.read_tolerant(spark, f"{folder}/*.jsonl", schema, "sample_id").orderBy("sample_id").collect()] == ["x", "y"]
    assert records.read_optional(spark, f"{folder}/none.jsonl", schema).count() == 0
    assert records.count_lines(spark, f"{folder}/a.jsonl") == 2
    many = records.read_many(spark, f"{folder}/*.jsonl", schema).orderBy("file", "block", "line").collect()
    assert [(r["file"], r["n"]) for r in many] == [("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 3)]
    with pytest.raises(FileNotFoundError):
        records.read_many(spark, f"{folder}/*.none", schema)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2)], "sample_id string, n int, _tmp int")
    records.overwrite(rows, f"{tmp_path}/out")
    records.append(rows.drop("_tmp"), f"{tmp_path}/out")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*.json") for x in p.read_text().splitlines()]
    assert lines == [{"sample_id": "a", "n": 1}] * 2
    assert records.stage_done(spark, f"{tmp_path}/out") and not records.stage_done(spark, f"{tmp_path}/no")
    assert records.remaining(rows, rows, ["sample_id"]).count() == 0


def test_adapters(spark):
    plain = spark.createDataFrame([(1, "Q?", "['a', 'b']"), (2, "Q2?", "")], "idx int, question string, answers string")
    one = adapters.adapt("docvqa", plain).collect()
    assert [(r["sample_id"], r["gt_answer"], r["gt_answer_aliases"]) for r in one] == [("docvqa_val_00000001", "a", ["a", "b"])]
    votes = spark.createDataFrame([(1, "Q?", ["b", "a", "a", "b", "c"])], "idx int, question string, answers array<string>")
    assert adapters.adapt("textvqa", votes).first()["gt_answer"] == "b"
    claims = spark.createDataFrame([(1, "C", "0"), (2, "D", "entailed")], "idx int, statement string, label string")
    assert {r["gt_answer"] for r in adapters.adapt("tabfact", claims).collect()} == {"refuted", "entailed"}
    tables = spark.createDataFrame([(1, "Q", ["a", " ", "b"])], "idx int, question string, answers array<string>")
    got = adapters.adapt("wtq", tables).first()
    assert (got["gt_answer"], got["gt_answer_aliases"]) == ("a | b", ["a", "b"])
    receipts = spark.createDataFrame([(1, "ACME", None), (2, None, None)], "idx int, company string, total string")
    assert [json.loads(r["gt_answer"])["company"] for r in adapters.adapt("sroie", receipts).collect()] == ["ACME"]
    pages = spark.createDataFrame([Row(idx=1, width=200.0, height=100.0, elements=[Row(label="table", box=[20.0, 10.0, 100.0, 50.0])]), Row(idx=2, width=1.0, height=1.0, elements=[])], "idx long, width double, height double, elements array<struct<label:string, box:array<double>>>")
    assert {r["gt_answer"] for r in adapters.adapt("publaynet", pages).collect()} == {"table", "[0.1000, 0.1000, 0.6000, 0.6000]"}
    tagged = [(1, i, w, t) for i, (w, t) in enumerate([("Name", "B-QUESTION"), ("of", "I-QUESTION"), ("x", "O"), ("Bob", "B-ANSWER"), ("Date", "B-QUESTION"), ("Sum", "B-QUESTION"), ("5", "B-ANSWER")])]
    pairs = adapters.form_pairs(spark.createDataFrame(tagged, "form int, position int, word string, tag string"))
    assert {(r["question"], r["answer"]) for r in pairs.collect()} == {("Name of", "Bob"), ("Sum", "5")}
    with pytest.raises(ValueError):
        adapters.adapt("unknown", plain)


def test_html_tables(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>x</p><table><tr><th>A</th><td> 1 <b>2</b></td></tr><tr><td>3</td></tr></table><table><tbody><tr><td>z</td></tr></tbody></table>")
    spark.dataSource.register(adapters.HtmlTables)
    got = spark.read.format("html_tables").load(str(tmp_path)).orderBy("table_no", "row_no").collect()
    assert [(r["table_no"], r["row_no"], r["cells"]) for r in got] == [(0, 0, ["A", "1 2"]), (0, 1, ["3"]), (1, 0, ["z"])]


def test_tables_of_any_shape(spark):
    texts = ['[["a", 1], ["b", 2]]', '{"header": ["x", "y"], "rows": [[1, 2]]}', '{"columns": [], "data": [["z"]]}', "<table><tr><td>q</td></tr></table>", 'a,"b\nc"\n\nd,e', "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", shapes.normal_table("t").alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [[["a", "1"], ["b", "2"]], [["x", "y"], ["1", "2"]], [["z"]], [["q"]], [["a", "b\nc"], ["d", "e"]], [], []]


def test_layouts(spark):
    objects = [(1, 100.0, 200.0, [Row(category_id=2, label=None, box=[10.0, 20.0, 50.0, 100.0]), Row(category_id=None, label="Table", box=[50.0, 50.0, 20.0, 10.0]), Row(category_id=9, label=None, box=[1.0, 1.0, 2.0, 2.0])])]
    frame = spark.createDataFrame(objects, "idx long, width double, height double, objects array<struct<category_id:int, label:string, box:array<double>>>")
    got = frame.select(shapes.layout_elements(F.col("objects"), F.col("width"), F.col("height")).alias("e")).first()["e"]
    assert [(e["label"], e["box"]) for e in got] == [("title", [0.1, 0.1, 0.5, 0.5]), ("table", [0.5, 0.25, 0.7, 0.3])]
    zipped = spark.createDataFrame([(1, 100.0, 100.0, [[10.0, 10.0, 50.0, 50.0], [0.1, 0.1, 0.2, 0.2], [1.0]], ["Section-header", "Odd", "Text"])], "idx long, width double, height double, boxes array<array<double>>, labels array<string>")
    got = zipped.select(shapes.zipped_elements(F.col("boxes"), F.col("labels"), F.col("width"), F.col("height")).alias("e")).first()["e"]
    assert [(e["label"], e["box"]) for e in got] == [("title", [0.1, 0.1, 0.5, 0.5]), ("odd", [0.1, 0.1, 0.2, 0.2])]
    assert adapters.adapt("doclaynet", zipped).count() == 2 and adapters.adapt("doclaynet", frame).count() == 2
    pages = shapes.synthetic_layout(spark, 30)
    sizes = [len(r["elements"]) for r in pages.collect()]
    assert len(sizes) == 30 and all(3 <= n <= 7 for n in sizes) and pages.exceptAll(shapes.synthetic_layout(spark, 30)).count() == 0
    assert all(0 <= b[0] and b[0] + b[2] <= 800 and b[1] + b[3] <= 1100 for r in pages.collect() for _, b in r["elements"])


def test_pages_words_and_fields(spark):
    many = spark.createDataFrame([(1, ["p0", "p1", None], 1), (2, ["p0"], 7), (3, None, None)], "idx int, images array<string>, page_idx int")
    pages, evidence = shapes.pages_of(many)
    assert [(r["p"], r["e"]) for r in many.select("idx", pages.alias("p"), evidence.alias("e")).orderBy("idx").collect()] == [(["p0", "p1"], "p1"), (["p0"], None), ([], None)]
    wide = spark.createDataFrame([("a", None, "c")], "image_1 string, image_2 string, image_3 string")
    assert wide.select(shapes.pages_of(wide)[0].alias("p")).first()["p"] == ["a", "c"]
    assert many.select(shapes.page_count(many).alias("n")).collect()[2]["n"] == 10
    nested = spark.createDataFrame([(1, [Row(lines=[Row(words=[Row(text="a"), Row(text=" ")]), Row(words=[Row(text="b")])])], None), (2, None, '"1 2 3 4 1\\n- 1 2 3 4 0 0 hello\\n- 1 2 3 4 0 1\\n"')], "idx int, paragraphs array<struct<lines:array<struct<words:array<struct<text:string>>>>>>, words_text string")
    assert {r["gt_answer"] for r in adapters.adapt("hiertext", nested).collect()} == {"a b", "hello"}
    receipts = spark.createDataFrame([(1, '{"gt_parse": {"menu": {"nm": "tea", "price": {"unit": {"value": "3"}}}, "total": ""}}'), (2, "{}"), (3, "no json")], "idx int, ground_truth string")
    assert [json.loads(r["gt_answer"]) for r in adapters.adapt("cord", receipts).collect()] == [{"menu.nm": "tea", "menu.price.unit.value": "3"}]
    tagged = spark.createDataFrame([(1, ["On", "Ships", "we", "sail"], ["title", "title", "paragraph", "odd"]), (2, ["x"], ["odd"])], "idx int, tokens array<string>, labels array<string>")
    assert [(r["gt_answer"], "On Ships" in r["query"]) for r in adapters.adapt("docbank", tagged).orderBy("sample_id").collect()] == [("title", True), ("odd", False)]
    forms = spark.createDataFrame([(1, "ACME", "9")], "idx int, committee string, amount string")
    assert json.loads(adapters.adapt("deepform", forms).first()["gt_answer"]) == {"advertiser": "ACME", "contract_start_date": None, "contract_end_date": None, "total_amount": "9"}
    nested_qas = spark.createDataFrame([(1, [Row(question="Q", answers=["a"])] * 1001), (2, [Row(question="Q", answers=["a"])])], "idx int, qas array<struct<question:string, answers:array<string>>>")
    ids = [r["sample_id"] for r in adapters.adapt("stvqa", nested_qas).collect()]
    assert len(ids) == len(set(ids)) == 1002


def test_adapter_runs(spark, tmp_path):
    plain = spark.createDataFrame([(1, "Q?", "a")], "idx int, question string, answers string")

    def broken():
        raise OSError("gone")

    told = adapters.run_adapters({"docvqa": lambda: plain, "chartqa": broken}, str(tmp_path / "out"))
    assert [(r["dataset"], r["status"], r["count"]) for r in told] == [("chartqa", "error", 0), ("docvqa", "success", 1)] and "gone" in told[0]["error"]
    assert adapters.load_adapter("gradeworks.sources.adapters.table_claims") is adapters.table_claims
    assert shapes.first_readable([broken, lambda: 5]) == 5
    with pytest.raises(OSError):
        shapes.first_readable([broken])


def test_vectors_reports_and_progress(spark, tmp_path):
    import numpy as np

    from gradeworks.sources import catalogue, clients

    np.savez(tmp_path / "v.npz", sample_ids=np.array(["a", "b"]), embeddings=np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert {(r["sample_id"], tuple(r["embedding"])) for r in shapes.vectors_of_archive(spark, str(tmp_path / "v.npz")).collect()} == {("a", (1.0, 2.0)), ("b", (3.0, 4.0))}
    with pytest.raises(FileNotFoundError):
        shapes.vectors_of_archive(spark, str(tmp_path / "none.npz"))
    (tmp_path / "ids.json").write_text('["a", "b",\n "c"]')
    assert records.read_ids(spark, str(tmp_path / "ids.json")).count() == 3
    text = records.write_text(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "report"), "Counts")
    assert text.splitlines() == ["Counts", "======", "name  n", "a     1"] and spark.read.text(str(tmp_path / "report")).count() == 4
    now = [0.0]
    progress = clients.Progress(10, lambda: now[0])
    assert progress.tick(0) == (0, "unknown")
    now[0] = 60.0
    assert progress.tick(5) == (5, "1.0min")
    clients.register("fake", lambda answer: lambda q, c, i: (answer, 1, 1))
    assert clients.client_of("fake", answer="x")("q", "c", None) == ("x", 1, 1)
    with pytest.raises(ValueError):
        clients.client_of("none")
    assert callable(catalogue.raw_models)


def test_many_splits_of_one_file(spark, tmp_path):
    """Records of one file read in several splits come in the order of the file."""
    (tmp_path / "big.jsonl").write_text("".join(f'{{"sample_id": "s", "n": {i}}}\n' for i in range(5000)))
    schema = spark.createDataFrame([], SCHEMA).schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        many = records.read_many(spark, str(tmp_path / "*.jsonl"), schema)
        assert many.select("block").distinct().count() > 3
        assert [r["n"] for r in many.orderBy("file", "block", "line").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
