"""Shapes that raw records come in: tables, layouts, pages, vectors and wrapped documents."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_leaves, strip

#: Numbers and names of layout labels.
LABEL_NUMBERS = {1: "text", 2: "title", 3: "list", 4: "table", 5: "figure"}
LABEL_NAMES = {"Text": "text", "Section-header": "title", "Title": "title", "List-item": "list", "Table": "table", "Figure": "figure", "Caption": "text", "Footnote": "text", "Formula": "text", "Page-header": "title", "Page-footer": "text", "Picture": "figure", "Checkbox-selected": "text", "Checkbox-unselected": "text"}
#: Words by which a question speaks of a table, and page labels from the most telling on.
TABLE_WORDS = ("table", "column", "row", "rows", "columns", "cell")
PAGE_LABELS = ("title", "abstract", "section", "author", "caption", "table", "figure", "equation", "list", "reference", "date", "footer", "paragraph")


def csv_rows(text: str) -> list[list[str]]:
    """The rows of a text in CSV form, quoted line breaks kept, empty rows dropped."""
    return [row for row in csv.reader(io.StringIO(text)) if row]


def table_rows(text: str | None) -> list[list[str]]:
    """A table as rows of texts, from a JSON list of rows, a JSON object with header and rows, HTML, or CSV."""
    from .adapters import table_cells

    plain = (text or "").strip()
    if plain.startswith("<"):
        return [cells for n, _, cells in table_cells(plain) if n == 0]
    if plain[:1] in ("[", "{"):
        try:
            value = json.loads(plain)
        except ValueError:
            return csv_rows(plain)
        if isinstance(value, dict):
            head = value.get("header", value.get("columns", []))
            value = ([head] if head else []) + list(value.get("rows", value.get("data", [])))
        if all(isinstance(row, list) for row in value):
            return [[str(cell) for cell in row] for row in value]
    return csv_rows(plain) if plain else []


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def normal_table(texts: pd.Series) -> pd.Series:
    """:func:`table_rows` over a column; nothing for null and blank."""
    return pd.Series([table_rows(t) for t in texts], dtype=object)


def corners(box: Column, width: Column, height: Column, form: str | None = None) -> Column:
    """A box as corners in the unit square, 4 places.

    ``form`` is ``xyxy`` or ``coco`` (x, y, width, height); without it a box whose third and fourth
    numbers exceed its first two is taken for corners.
    """
    x, y, a, b = (box[i].cast("double") for i in range(4))
    plain = F.lit(form == "xyxy") if form else (a > x) & (b > y)
    right, low = F.when(plain, a).otherwise(x + a), F.when(plain, b).otherwise(y + b)
    return F.array(*[F.round(v, 4) for v in (x / width, y / height, right / width, low / height)])


def layout_elements(objects: Column, width: Column, height: Column) -> Column:
    """Layout records (category_id, label, box) as label and corners; those without a label or a box of four are dropped."""
    numbered = F.lit(None).cast("string")
    def named(o: Column) -> Column:
        out = numbered
        for n, name in LABEL_NUMBERS.items():
            out = F.when(o["category_id"] == n, F.lit(name)).otherwise(out)
        return F.coalesce(out, F.lower(o["label"]))

    made = F.transform(objects, lambda o: F.when(named(o).isNotNull() & (F.size(o["box"]) == 4), F.struct(named(o).alias("label"), corners(o["box"], width, height).alias("box"))))
    return F.array_compact(made)


def zipped_elements(boxes: Column, labels: Column, width: Column, height: Column) -> Column:
    """Boxes and labels that come as two arrays: names by their short form, corners scaled if any exceeds 1."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])

    def one(z: Column) -> Column:
        box = z["boxes"]
        name = F.coalesce(F.try_element_at(known, z["labels"]), F.lower(z["labels"]))
        scaled = F.when(F.array_max(box) > 1, corners(box, width, height, "xyxy")).otherwise(F.transform(box, lambda v: F.round(v.cast("double"), 4)))
        return F.when(z["labels"].isNotNull() & (z["labels"] != "") & (F.size(box) == 4), F.struct(name.alias("label"), scaled.alias("box")))

    return F.array_compact(F.transform(F.arrays_zip(boxes.alias("boxes"), labels.alias("labels")), one))


def synthetic_layout(spark: SparkSession, pages: int, seed: int = 42) -> DataFrame:
    """Pages of 800 x 1100 with three to seven boxes drawn by hash: idx, width, height, elements."""
    def draw(what: str, low: Column | int, high: Column | int) -> Column:
        span = F.greatest((F.lit(high) if isinstance(high, int) else high) - low + 1, F.lit(1))
        return (F.pmod(F.xxhash64(F.col("idx"), F.col("e"), F.lit(what), F.lit(seed)), span) + low).cast("double")

    page = spark.range(pages).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(1), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(5)) + 3).cast("int"))).alias("e"))
    page = page.withColumns({"x": draw("x", 20, 400), "y": draw("y", 20, 550), "kind": draw("kind", 1, 5).cast("int")})
    page = page.withColumns({"w": draw("w", 40, F.least(F.lit(300.0), 780 - F.col("x"))), "h": draw("h", 20, F.least(F.lit(200.0), 1080 - F.col("y")))})
    name = F.lit(None).cast("string")
    for n, label in LABEL_NUMBERS.items():
        name = F.when(F.col("kind") == n, F.lit(label)).otherwise(name)
    element = F.struct("e", name.alias("label"), F.array("x", "y", "w", "h").alias("box"))
    boxes = F.transform(F.array_sort(F.collect_list(element)), lambda z: F.struct(z["label"].alias("label"), z["box"].alias("box")))
    return page.groupBy("idx").agg(boxes.alias("elements")).select("idx", F.lit(800.0).alias("width"), F.lit(1100.0).alias("height"), "elements")


def paragraph_words(paragraphs: Column) -> Column:
    """The words of nested paragraphs (lines of words with a text), in order, blanks dropped."""
    lines = F.flatten(F.transform(paragraphs, lambda p: F.coalesce(p["lines"], F.array().cast("array<struct<words:array<struct<text:string>>>>"))))
    words = F.flatten(F.transform(lines, lambda line: F.transform(F.coalesce(line["words"], F.array().cast("array<struct<text:string>>")), lambda w: strip(w["text"]))))
    return F.filter(words, lambda w: w.isNotNull() & (w != ""))


def listed_words(text: Column) -> Column:
    """The words of lines ``- x y w h hand ill WORD``, as one source ships them, escaped line breaks undone."""
    plain = F.regexp_replace(F.regexp_replace(text, r'^"|"$', ""), r"\\n", "\n")
    lines = F.transform(F.split(plain, "\n"), strip)
    form = r"^-\s+(?:\S+\s+){6}(.+)$"
    return F.filter(F.transform(lines, lambda line: F.regexp_extract(line, form, 1)), lambda w: w != "")


def speaks_of_table(question: Column) -> Column:
    """Whether a question names a table or a part of one."""
    low, out = F.lower(F.coalesce(question, F.lit(""))), F.lit(False)
    for word in TABLE_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


def pages_of(df: DataFrame, most: int = 20) -> tuple[Column, Column]:
    """The pages of a record and the one that holds the evidence.

    Pages come as ``image``, as a list ``images`` or as ``image_1`` to ``image_20``.  Where a page of
    evidence is given and exists, counted from 0, it alone is told, else null: all pages count.
    """
    here = [F.array(F.col("image"))] if "image" in df.columns else []
    here += [F.col("images")] if "images" in df.columns else []
    numbered = [F.col(f"image_{i}") for i in range(1, most + 1) if f"image_{i}" in df.columns]
    here += [F.array(*numbered)] if numbered else []
    lists = [F.array_compact(x) for x in here]
    pages = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<string>"))
    given = [F.col(c).cast("int") for c in ("evidence_page_no", "page_idx") if c in df.columns]
    at = F.coalesce(*given, F.lit(None).cast("int"))
    return pages, F.when((at >= 0) & (at < F.size(pages)), F.get(pages, at))


def page_count(df: DataFrame, default: int = 10) -> Column:
    """The pages of a form by any of the usual names, else the length of a list of pages, else ``default``."""
    named = [F.when(F.col(c) > 0, F.col(c)).cast("int") for c in ("num_pages", "page_count", "n_pages", "total_pages") if c in df.columns]
    listed = [F.when(F.size(c) > 0, F.size(c)) for c in ("images", "pdf_pages", "pages") if c in df.columns]
    return F.coalesce(*named, *listed, F.lit(default))


def telling_label(labels: Column) -> Column:
    """The most telling of a page's labels, its first where none is known, ``paragraph`` without any."""
    known = F.array(*map(F.lit, PAGE_LABELS))
    places = F.filter(F.transform(labels, lambda x: F.array_position(known, x)), lambda p: p > 0)
    return F.coalesce(F.get(known, (F.array_min(places) - 1).cast("int")), F.get(labels, 0), F.lit("paragraph"))


def excerpt(tokens: Column, labels: Column, label: Column, most: int = 8, chars: int = 120) -> Column:
    """The first tokens with a label, at most ``most``, as text of at most ``chars`` characters."""
    own = F.filter(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda z: z["l"] == label)
    return F.left(F.array_join(F.filter(F.transform(F.slice(own, 1, most), lambda z: strip(z["t"])), lambda t: t != ""), " "), F.lit(chars))


def unwrapped(document: Column, key: str = "gt_parse") -> Column:
    """The leaves of a JSON object, or of the object under ``key`` in it."""
    inner = F.get_json_object(document, f"$.{key}")
    return json_leaves(F.when(strip(inner).startswith("{"), inner).otherwise(document))


def vectors_of_archive(spark: SparkSession, path: str, ids: str = "sample_ids", values: str = "embeddings", block: int = 5000) -> DataFrame:
    """``sample_id, embedding`` of archives of arrays (.npz): one task per file, rows in blocks.

    A path that matches no file raises, and so does an archive without the two arrays.
    """
    from .records import exists

    if not exists(spark, path):
        raise FileNotFoundError(path)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    names, rows = archive[ids], archive[values]
                for at in range(0, len(names), block):
                    yield pd.DataFrame({"sample_id": [str(x) for x in names[at : at + block]], "embedding": [v.astype("float32") for v in rows[at : at + block]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "sample_id string, embedding array<float>")


def first_readable(readers: Sequence) -> object:
    """What the first of several readers gives that does not fail; the last failure is raised if all do."""
    failure: Exception | None = None
    for reader in readers:
        try:
            return reader()
        except Exception as e:  # noqa: BLE001
            failure = e
    raise failure if failure else ValueError("no reader")
