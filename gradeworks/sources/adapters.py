"""Source adapters: raw records of question-answer sources to one schema of samples.

An adapter is a function from a table of raw records to samples.  Columns that a source may name
differently are found by candidates; rows without an answer are dropped where the source has none.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scores import CLAIMS, CLASSES
from ..functions.features import region
from ..functions.text import sample_id, strip
from ..functions.trees import Tree
from . import shapes

SAMPLE = ("sample_id", "source_dataset", "task_type", "query", "gt_answer", "gt_answer_aliases", "correctness_metric")


def first_of(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first non-null of the candidate columns that exist; null of ``kind`` without any."""
    here = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*here, F.lit(None).cast(kind))


def to_samples(df: DataFrame, name: str, task: str, metric: str, query: Column, answers: Column, split: str = "val", order: str = "idx", part: str | None = None) -> DataFrame:
    """Samples from queries and arrays of answers: the first answer leads, blanks are dropped.

    An id is that of the record; ``part`` names a column that tells several samples of a record apart.
    """
    kept = F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: a.isNotNull() & (strip(a) != ""))
    rows = df.withColumn("__q", query).withColumn("__a", kept).where(F.size("__a") > 0)
    made = sample_id(F.lit(name.lower().replace("-", "")), F.lit(split), F.col(order))
    if part:
        made = F.concat_ws("_", made, F.col(part).cast("string"))
    return rows.select(made.alias("sample_id"), F.lit(name).alias("source_dataset"), F.lit(task).alias("task_type"), F.col("__q").alias("query"), F.col("__a")[0].alias("gt_answer"), F.col("__a").alias("gt_answer_aliases"), F.lit(metric).alias("correctness_metric"))


def page_classes(df: DataFrame) -> DataFrame:
    """Class numbers to names, one fixed question."""
    names = F.array(*map(F.lit, CLASSES))
    return to_samples(df, "RVL-CDIP", "T1", "exact_match", F.lit("What is the class of this document?"), F.array(F.get(names, F.col("label").cast("int"))), "test")


def form_pairs(df: DataFrame) -> DataFrame:
    """Tagged words of forms to question and answer pairs.

    Runs of one tag are collapsed to entities; a question takes the next answer, unless another
    question comes first.  Input: form, position, word, tag (B-, I-, O).
    """
    place = Window.partitionBy("form").orderBy("position")
    named = df.withColumn("kind", F.regexp_extract("tag", r"^[BI]-(.+)$", 1)).withColumn("starts", F.col("tag").startswith("B-") | (F.regexp_extract("tag", r"^[BI]-(.+)$", 1) != F.coalesce(F.lag(F.regexp_extract("tag", r"^[BI]-(.+)$", 1)).over(place), F.lit(""))))
    run = F.sum(F.col("starts").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    entities = named.withColumn("run", run).where("kind in ('QUESTION', 'ANSWER')").groupBy("form", "run", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]), " ").alias("text"), F.min("position").alias("at"))
    order = Window.partitionBy("form").orderBy("at")
    linked = entities.withColumn("next_kind", F.lead("kind").over(order)).withColumn("answer", F.lead("text").over(order))
    return linked.where("kind = 'QUESTION' and next_kind = 'ANSWER'").select("form", F.col("text").alias("question"), "answer")


def most_common_answer(df: DataFrame, name: str = "TextVQA", task: str = "T2") -> DataFrame:
    """The answer most annotators gave leads, the earliest on a tie; all stay as aliases."""
    given = F.transform("answers", lambda a, i: F.struct((-F.size(F.filter("answers", lambda b: b == a))).alias("n"), i.alias("i"), a.alias("a")))
    lead = F.array_min(given)["a"]
    rows = df.withColumn("__all", F.concat(F.array(lead), F.col("answers")))
    made = to_samples(rows, name, task, "vqa_accuracy", F.col("question"), F.col("__all"))
    return made.withColumn("gt_answer_aliases", F.slice("gt_answer_aliases", 2, 1 << 20))


def nested_questions(df: DataFrame, name: str = "ST-VQA", task: str = "T2", metric: str = "anls") -> DataFrame:
    """One row per question in an array of (question, answers)."""
    rows = df.select("idx", F.posexplode("qas").alias("n", "qa"))
    return to_samples(rows, name, task, metric, F.col("qa.question"), F.col("qa.answers"), part="n")


def plain_questions(df: DataFrame, name: str, task: str, metric: str) -> DataFrame:
    """Question and answer under any of their usual names; lists of answers may come as text."""
    listed = F.from_json(F.regexp_replace(first_of(df, ["answers"]), "'", '"'), "array<string>")
    answers = F.coalesce(listed, F.array(first_of(df, ["answer", "label", "response", "answers"])))
    return to_samples(df, name, task, metric, first_of(df, ["question", "query", "questions", "prompt"]), answers)


def table_claims(df: DataFrame) -> DataFrame:
    """Claims about tables, labels as words or 0 and 1."""
    label = F.lower(strip(first_of(df, ["label", "answer"])))
    named = label
    for spelling, word in CLAIMS.items():
        named = F.when(label == spelling, F.lit(word)).otherwise(named)
    return to_samples(df, "TabFact", "T4", "exact_match", first_of(df, ["claim", "statement", "question"]), F.array(named), "test")


def table_answers(df: DataFrame) -> DataFrame:
    """Questions to tables: several answers are joined by a spaced bar, each stays an alias."""
    kept = F.filter("answers", lambda a: strip(a) != "")
    rows = df.withColumn("__k", kept).withColumn("__all", F.concat(F.array(F.array_join("__k", " | ")), F.col("__k")))
    return to_samples(rows, "WikiTableQuestions", "T4", "denotation", F.col("question"), F.col("__all")).withColumn("gt_answer_aliases", F.slice("gt_answer_aliases", 2, 1 << 20))


def receipt_fields(df: DataFrame, fields: Sequence[str] = ("company", "date", "address", "total")) -> DataFrame:
    """Named fields of receipts as JSON, empty ones as empty text; receipts without any are dropped."""
    values = [F.coalesce(strip(first_of(df, [f, f.upper(), f.capitalize()])), F.lit("")).alias(f) for f in fields]
    filled = F.array_join(F.array(*values), "") != ""
    return to_samples(df, "SROIE", "T2", "field_f1", F.lit("Extract the fields as JSON."), F.array(F.when(filled, F.to_json(F.struct(*values)))), "test")


def page_elements(df: DataFrame) -> DataFrame:
    """Layout pages to one question about an element's label and one about its box.

    The elements asked for are those with the least hash of page, place and purpose.  Boxes come as
    (x, y, width, height) with the page's size, and leave as corners in the unit square, 4 places.
    """
    def corner(e: Column) -> Column:
        return F.array(*[F.round(x, 4) for x in (e["box"][0] / F.col("width"), e["box"][1] / F.col("height"), (e["box"][0] + e["box"][2]) / F.col("width"), (e["box"][1] + e["box"][3]) / F.col("height"))])

    def pick(purpose: str) -> Column:
        keyed = F.transform("elements", lambda e, i: F.struct(F.md5(F.concat_ws(":", F.col("idx").cast("string"), i.cast("string"), F.lit(purpose))).alias("h"), e["label"].alias("label"), corner(e).alias("box")))
        return F.array_min(keyed)

    rows = df.where(F.size("elements") > 0).withColumn("a", pick("label")).withColumn("b", pick("box"))
    where = region((F.col("a.box")[0] + F.col("a.box")[2]) / 2, (F.col("a.box")[1] + F.col("a.box")[3]) / 2)
    asked = to_samples(rows, "PubLayNet", "T3", "exact_match", F.concat(F.lit("What kind of element lies at the "), where, F.lit(" of the page?")), F.array(F.col("a.label")))
    text = F.format_string("[%.4f, %.4f, %.4f, %.4f]", *[F.col("b.box")[i] for i in range(4)])
    boxed = to_samples(rows.withColumn("part", F.lit("box")), "PubLayNet", "T6", "iou", F.concat(F.lit("Give the box of the "), F.col("b.label"), F.lit(".")), F.array(text), part="part")
    return asked.unionByName(boxed)


def nested_fields(df: DataFrame) -> DataFrame:
    """Nested fields of receipts, unwrapped and flattened to dotted names, as JSON; records without any are dropped."""
    leaves = shapes.unwrapped(first_of(df, ["ground_truth", "gt_parse", "annotation"]))
    rows = df.withColumn("__leaves", leaves).where(F.size("__leaves") > 0)
    names = F.array_join(F.map_keys("__leaves"), ", ")
    return to_samples(rows, "CORD", "T2", "field_f1", F.concat(F.lit("Extract the following fields: "), names), F.array(F.to_json("__leaves")), "test")


def page_text(df: DataFrame) -> DataFrame:
    """All words of a page as its text, from nested paragraphs or from listed words."""
    words = [shapes.paragraph_words(F.col("paragraphs"))] if "paragraphs" in df.columns else []
    words += [shapes.listed_words(first_of(df, ["words_text", "output_json_dumpsed"]))]
    found = F.coalesce(*[F.when(F.size(w) > 0, w) for w in words])
    rows = df.withColumn("__text", F.array_join(found, " "))
    return to_samples(rows, "HierText", "T2", "anls", F.lit("What text is on this page?"), F.array("__text"))


def page_roles(df: DataFrame) -> DataFrame:
    """Tagged tokens of pages to one question about the role of an excerpt, by the most telling role there is."""
    tokens, labels = (F.col(next(c for c in names if c in df.columns)) for names in (("tokens", "token", "words", "word"), ("tags", "labels", "tag", "label")))
    rows = df.where((F.size(tokens) > 0) & (F.size(labels) > 0)).withColumn("__label", shapes.telling_label(labels))
    own = shapes.excerpt(tokens, labels, F.col("__label"))
    rows = rows.withColumn("__text", F.when(own != "", own).otherwise(F.array_join(F.slice(tokens, 1, 6), " ")))
    return to_samples(rows, "DocBank", "T3", "exact_match", F.concat(F.lit("Which part of a paper is this: "), F.col("__text"), F.lit("?")), F.array("__label"), "test")


#: The fields of disclosure forms and the names they go by.
FORM_FIELDS = {
    "advertiser": ("advertiser", "Advertiser", "advertiser_name", "political_committee", "committee"),
    "contract_start_date": ("contract_start_date", "start_date", "ContractStartDate", "from_date", "period_start"),
    "contract_end_date": ("contract_end_date", "end_date", "ContractEndDate", "to_date", "period_end"),
    "total_amount": ("total_amount", "amount", "TotalAmount", "gross_amount", "contract_amount", "total"),
}


def disclosure_fields(df: DataFrame) -> DataFrame:
    """Four fields of disclosure forms under any of their names, as JSON with null for those not found."""
    values = [F.nullif(strip(F.coalesce(first_of(df, [n for n in names if n in df.columns]), F.lit(""))), F.lit("")).alias(field) for field, names in FORM_FIELDS.items()]
    return to_samples(df, "DeepForm", "T5", "field_f1", F.lit("Extract the fields as JSON."), F.array(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})), "test")


def layout_pages(df: DataFrame) -> DataFrame:
    """Layout records of either form to the questions of :func:`page_elements`.

    Input: idx, width, height, and objects (category_id, label, box) or boxes and labels.
    """
    made = shapes.zipped_elements(F.col("boxes"), F.col("labels"), F.col("width"), F.col("height")) if "boxes" in df.columns else shapes.layout_elements(F.col("objects"), F.col("width"), F.col("height"))
    # Corners in the unit square, as x, y, width and height of a page of size 1.
    plain = F.transform(made, lambda e: F.struct(e["label"].alias("label"), F.array(e["box"][0], e["box"][1], e["box"][2] - e["box"][0], e["box"][3] - e["box"][1]).alias("box")))
    return page_elements(df.select("idx", F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), plain.alias("elements")))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rvlcdip": page_classes,
    "textvqa": most_common_answer,
    "stvqa": nested_questions,
    "docvqa": lambda df: plain_questions(df, "DocVQA", "T4", "anls"),
    "infographicvqa": lambda df: plain_questions(df, "InfographicVQA", "T4", "anls"),
    "chartqa": lambda df: plain_questions(df, "ChartQA", "T4", "relaxed_accuracy"),
    "visualmrc": lambda df: plain_questions(df, "VisualMRC", "T4", "rouge_cider"),
    "mpdocvqa": lambda df: plain_questions(df, "MP-DocVQA", "T5", "anls"),
    "slidevqa": lambda df: plain_questions(df, "SlideVQA", "T5", "slidevqa_em"),
    "cord": nested_fields,
    "sroie": receipt_fields,
    "hiertext": page_text,
    "funsd": lambda df: to_samples(form_pairs(df).withColumn("idx", F.col("form")).withColumn("n", F.row_number().over(Window.partitionBy("form").orderBy("question", "answer"))), "FUNSD", "T2", "field_f1", F.concat(F.lit("What is the value of "), F.col("question"), F.lit("?")), F.array("answer"), part="n"),
    "tabfact": table_claims,
    "wtq": table_answers,
    "publaynet": page_elements,
    "doclaynet": layout_pages,
    "docbank": page_roles,
    "deepform": disclosure_fields,
}


def adapt(name: str, raw: DataFrame) -> DataFrame:
    """The samples of a source by its name; an unknown name raises."""
    if name not in ADAPTERS:
        raise ValueError(f"no adapter for {name}")
    return ADAPTERS[name](raw)


def load_adapter(path: str) -> Callable[[DataFrame], DataFrame]:
    """An adapter by its dotted path, such as ``package.module.function``."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def run_adapter(name: str, raw: Callable[[], DataFrame], out: str, adapter: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, object]:
    """Read a source, adapt it and append its samples to a folder; what came of it: status, count, seconds, error."""
    began = time.monotonic()
    told: dict[str, object] = {"dataset": name, "status": "success", "count": 0, "error": None}
    try:
        made = (adapter or ADAPTERS[name])(raw())
        path = f"{out}/{name}"
        made.write.mode("overwrite").json(path)
        told["count"] = made.sparkSession.read.schema(made.schema).json(path).count()
    except Exception as e:  # noqa: BLE001
        told |= {"status": "error", "error": f"{type(e).__name__}: {e}"[:500]}
    return told | {"elapsed_s": round(time.monotonic() - began, 1)}


def run_adapters(sources: Mapping[str, Callable[[], DataFrame]], out: str, at_once: int = 4) -> list[dict[str, object]]:
    """:func:`run_adapter` for several sources, ``at_once`` of them side by side in one application; one failing stops no other."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        return sorted(pool.map(lambda item: run_adapter(item[0], item[1], out), sources.items()), key=lambda r: str(r["dataset"]))


class HtmlTables(DataSource):
    """A source of table cells in HTML files: ``spark.read.format("html_tables").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "html_tables"

    def schema(self) -> str:
        return "file string, table_no int, row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _HtmlReader(self.options["path"])


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _HtmlReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return [_Part(f.path) for f in found if f.path.endswith((".html", ".htm"))]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_stream(partition.path) as source:
            text = source.read().decode("utf-8", "replace")
        for t, r, cells in table_cells(text):
            yield (partition.path.rsplit("/", 1)[-1], t, r, cells)


def table_cells(markup: str):
    """``(table, row, cells)`` of all table rows in an HTML text, texts of cells joined and squeezed."""
    def text(node: list) -> str:
        return node[0] if not node[1] and node[0] not in ("td", "th", "br") else " ".join(filter(None, (text(c) for c in node[1])))

    count = 0

    def walk(node: list):
        nonlocal count
        for child in node[1]:
            if child[0] == "table":
                own, count = count, count + 1
                rows = [c for part in child[1] for c in ([part] if part[0] == "tr" else part[1] if part[0] in ("thead", "tbody", "tfoot") else []) if c[0] == "tr"]
                for r, row in enumerate(rows):
                    yield own, r, [" ".join(text(c).split()) for c in row[1] if c[0] in ("td", "th")]
            else:
                yield from walk(child)

    tree = Tree()
    tree.feed(markup)
    yield from walk(tree.root)
