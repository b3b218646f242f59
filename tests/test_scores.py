"""Answer metrics against golden cases and brute force."""

import random
import string

import pytest
from pyspark.sql import functions as F

from gradeworks.functions import scores, trees


def value(spark, make, *args):
    frame = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} {'array<string>' if isinstance(a, list) else 'string'}" for i, a in enumerate(args)))
    return frame.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(("p", "refs", "want"), [("yearly sumary", ["yearly summary"], True), ("walrus", ["yearly summary"], False), (None, ["x"], False), ("", [""], True), ("12,345", ["no", "12,345"], True), ("a", [], False)])
def test_anls(spark, p, refs, want):
    assert (value(spark, scores.anls, p, refs) >= 0.5) == want


@pytest.mark.parametrize(("p", "g", "want"), [("$2,050", "$2,000", True), ("2300", "2000", False), ("95%", "95", True), ("n/a", "n/a", False), ("West harbour office", "West harbour", True), ("West harbour", "West harbour office", True)])
def test_relaxed(spark, p, g, want):
    assert value(spark, scores.relaxed, p, [g]) is want


@pytest.mark.parametrize(("p", "g", "want"), [("", "", 1.0), ("x", "", 0.0), ("$1,234.56", "1234.56", 1.0), ("one", "one two three", 0.5), ('{"a": "x", "b": "y"}', "x y", 1.0)])
def test_field_f1(spark, p, g, want):
    assert value(spark, scores.word_f1, p, g) == pytest.approx(want)


@pytest.mark.parametrize(("p", "g", "source", "want"), [("Invoice", "invoice", "", True), ("news   article", "news article", "", True), ("1", "entailed", "TabFact", True), ("11", "invoice", "RVL-CDIP", True), ("11", "invoice", "", False)])
def test_exact(spark, p, g, source, want):
    assert value(spark, scores.exact, p, [g], source) is want


@pytest.mark.parametrize(("p", "g", "want"), [("[0.1,0.1,0.5,0.5]", "[0.1,0.1,0.5,0.5]", 1.0), ("[0,0,0.2,0.2]", "[0.5,0.5,0.9,0.9]", 0.0), ("[0.5,0.5,0.1,0.1]", "[0.1,0.1,0.5,0.5]", 0.0), ("[2,2,3,3]", "[0.1,0.1,0.5,0.5]", 0.0), ("nothing", "[0.1,0.1,0.5,0.5]", 0.0)])
def test_iou(spark, p, g, want):
    assert value(spark, scores.iou, p, [g]) == pytest.approx(want)


@pytest.mark.parametrize(("p", "g", "want"), [("1,234", "1234", True), ("January 5, 2020", "2020-01-05", True), ("03/15/2019", "2019-03-15", True), ("b; a", "a; b", True), ("$1,234", "1234", True), ("a", "b", False)])
def test_denotation(spark, p, g, want):
    assert value(spark, scores.denotation, p, [g]) is want


@pytest.mark.parametrize(("p", "refs", "want"), [("cat", ["cat"] * 3 + ["dog"] * 7, 1.0), ("cat", ["cat"] * 2 + ["dog"] * 8, 2 / 3), ("The Cat", ["cat"] * 3, 1.0), ("2", ["2.0"] * 3, 1.0), ("2", [], 0.0)])
def test_vqa(spark, p, refs, want):
    assert value(spark, scores.vqa, p, refs) == pytest.approx(want)


@pytest.mark.parametrize(("p", "g", "want"), [("1050", "1000", True), ("1100", "1000", False), ("Yes", "yes", True), ("0.04", "0", True)])
def test_slide(spark, p, g, want):
    assert value(spark, scores.slide, p, g, "What is the total revenue?") is want


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "p string, r string").select("p", "r", scores.rouge_l("p", F.array("r")).alias("v")).collect()
    for row in got:
        a, b = row["p"].split(), row["r"].split()
        both = longest(a, b)
        assert row["v"] == pytest.approx(1.0 if not a and not b else 0.0 if not both else 2 * both / (len(a) + len(b)))


def test_similarity_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(string.ascii_lowercase[:3] + "é ", k=rng.randint(0, 8))) for _ in range(80)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    for row in spark.createDataFrame(pairs, "a string, b string").select("a", "b", scores.similarity(F.col("a"), F.col("b")).alias("v")).collect():
        a, b = " ".join(row["a"].split()), " ".join(row["b"].split())
        most = max(len(a), len(b))
        off = distance(a, b) / most if most else 0
        assert row["v"] == pytest.approx(0.0 if off >= 0.5 else 1 - off)


def test_tables(spark):
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    cases = [(table, table, 1.0), ("| a | b |\n|---|---|", table, None), ("plain", table, None), ("", table, 0.0), (None, table, 0.0)]
    got = spark.createDataFrame([c[:2] for c in cases], "p string, r string").select(scores.table_similarity("p", "r").alias("v")).collect()
    assert got[0]["v"] == 1.0 and got[3]["v"] == got[4]["v"] == 0.0
    assert got[2]["v"] < 0.7


def test_tables_by_parts():
    assert trees.pipe_table("a | b\n--|--\n1 | 2") == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    assert trees.pipe_table("a | b\n1 | 2") == "a | b\n1 | 2"
    wrapped = "<html><body><p>x</p><table><tr><td>a</td></tr></table></body></html>"
    assert trees.read_tree(wrapped) == ["table", [["tr", [["td", [["a", []]]]]]]]
    assert trees.rough_similarity("<table><tr><td>1</td></tr></table>", "<table><tr><td>1</td><td>2</td></tr></table>") == 0.75
    assert trees.rough_similarity("one two", "two three") == 0.5 and trees.rough_similarity("", "!") == 1.0


GOLDEN = [
    ("vqa_accuracy", "red", "red", ["red"] * 9, True),
    ("vqa_accuracy", "red", "blue", ["red", "red", "blue"], False),
    ("vqa_accuracy", "red", "blue", ["red", "Red.", "the red", "blue"], True),
    ("vqa_accuracy", "red", "red", None, True),
    ("vqa_accuracy", "red", "red", ["blue"], False),
    ("vqa_accuracy", "é", "è", None, False),
    ("teds", "<td>a</td>", "<td>a </td>", None, True),
    ("teds", "nothing like it", "<table><tr><td>a</td><td>b</td></tr></table>", None, False),
    ("teds", "x|y\n-|-\n1|2", "<table><thead><tr><th>x</th><th>y</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>", None, True),
    ("field_f1", "total 12", "other", ["total: 12"], True),
    ("rouge_cider", "the ship left at noon", "a ship left the port at noon", None, True),
    ("rouge_cider", "nothing", "a ship left", ["words apart"], False),
    ("denotation", "b, a", "a; b", None, True),
    ("iou", "[0,0,1,1]", "[0,0,0.1,0.1]", ["[0,0,1,1]"], True),
    ("slidevqa_em", "105", "100", None, True),
    ("anls", "harbor", "harbour", None, True),
    ("exact_match", "Memo ", "memo", None, True),
    ("relaxed_accuracy", "41", "40", None, True),
]


def test_golden_rows_of_every_metric(spark):
    frame = spark.createDataFrame([(i, *g[:4]) for i, g in enumerate(GOLDEN)], "i int, m string, p string, g string, a array<string>")
    got = frame.select("i", scores.is_correct(*[F.col(c) for c in ("m", "p", "g", "a")], F.lit(""), F.lit("")).alias("v")).orderBy("i").collect()
    assert [(GOLDEN[r["i"]][:3], r["v"]) for r in got] == [(g[:3], g[4]) for g in GOLDEN]
    assert {g[0] for g in GOLDEN} == {"anls", "exact_match", "relaxed_accuracy", "field_f1", "iou", "rouge_cider", "denotation", "vqa_accuracy", "slidevqa_em", "teds"}


def test_dispatch(spark):
    frame = spark.createDataFrame([("ANLS", None, "x"), ("exact_match", "X", "x"), ("field_f1", "x", None)], "m string, p string, g string")
    empty = F.array().cast("array<string>")
    got = frame.select(scores.is_correct(F.col("m"), F.col("p"), F.col("g"), empty, F.lit(""), F.lit("")).alias("v")).collect()
    assert [r["v"] for r in got] == [False, True, False]
    with pytest.raises(Exception, match="unknown metric"):
        spark.createDataFrame([("bleu", "x", "x")], "m string, p string, g string").select(scores.is_correct(F.col("m"), F.col("p"), F.col("g"), empty, F.lit(""), F.lit("")).alias("v")).collect()


def test_field_f1_of_every_pair(spark, tmp_path):
    """Pairs with JSON get a score like any other."""
    from gradeworks.plans import text_queries

    cases = [('{"a": "x", "b": ["y", null]}', "x y", 1.0), ("x", '{"a": "x z"}', 2 / 3), ("[1.50, true]", "1.5 True", 1.0), ("{broken", "broken", 1.0), ("$1,020", "1020", 1.0), ('{"caf\\u00e9": "caf\\u00e9"}', "café", 1.0), ("{}", "[]", 1.0), ("{}", "x", 0.0)]
    now = F.lit("2026-01-01").cast("timestamp")
    rows = spark.createDataFrame([(i, f"s{i}", p, g) for i, (p, g, _) in enumerate(cases)], "result_id long, sample_id string, predicted_answer string, gt_answer string")
    rows.select("result_id", "sample_id", "predicted_answer", F.lit("observed").alias("result_type"), now.alias("ingested_at")).write.parquet(f"{tmp_path}/eval_results.parquet")
    rows.select("sample_id", "gt_answer", F.array().cast("array<string>").alias("gt_answer_aliases"), F.lit("x").alias("source_dataset"), F.lit("q").alias("query"), F.lit("field_f1").alias("correctness_metric"), now.alias("ingested_at")).write.parquet(f"{tmp_path}/bench_samples.parquet")
    got = {r["result_id"]: r["score"] for r in text_queries.score_field_f1(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: want for i, (_, _, want) in enumerate(cases)}, abs=1e-6)
