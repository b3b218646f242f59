"""Correctness of answers: ten metrics as expressions, and their dispatch.

A null prediction is wrong under every metric; so is any prediction against no reference.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PUNCTUATION, collapse, strip
from .trees import read_tree, rough_similarity, tree_distance, tree_size

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Spellings of the two labels of table claims, and the sixteen document classes by index.
CLAIMS = {"1": "entailed", "true": "entailed", "yes": "entailed", "support": "entailed", "supports": "entailed", "0": "refuted", "false": "refuted", "no": "refuted", "refute": "refuted", "contradict": "refuted", "contradicts": "refuted"}
CLASSES = ("letter", "form", "email", "handwritten", "advertisement", "scientific report", "scientific publication", "specification", "file folder", "news article", "budget", "invoice", "presentation", "questionnaire", "resume", "memo")
MISSING = ("n/a", "na", "none", "null", "-", "")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def number(text: Column) -> Column:
    """The double that a plain decimal numeral stands for, else null."""
    return F.when(text.rlike(NUMBER), text.cast("double"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 0 below one half, 1 for two empty texts."""
    x, y = F.lower(collapse(F.coalesce(a, F.lit("")))), F.lower(collapse(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    off = F.levenshtein(x, y) / longest
    return F.when(longest == 0, 1.0).when(off >= 0.5, 0.0).otherwise(1.0 - off)


def anls(predicted: Column, references: Column) -> Column:
    """The best :func:`similarity` to any reference, 0 without one or for a null prediction."""
    best = F.array_max(F.transform(references, lambda r: similarity(predicted, r)))
    return F.when(predicted.isNull(), 0.0).otherwise(F.coalesce(best, F.lit(0.0)))


def label_form(text: Column, source: Column) -> Column:
    """Lower case and single spaces; claims and document classes by their names."""
    base = F.lower(collapse(F.coalesce(text, F.lit(""))))
    kind = F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"[\s\-_]+", "")
    claim, index = base, base
    for spelling, name in CLAIMS.items():
        claim = F.when(base == spelling, F.lit(name)).otherwise(claim)
    for i, name in enumerate(CLASSES):
        index = F.when(base == str(i), F.lit(name)).otherwise(index)
    return F.when(kind == "tabfact", claim).when(kind == "rvlcdip", index).otherwise(base)


def exact(predicted: Column, references: Column, source: Column) -> Column:
    """Whether the prediction equals any reference in :func:`label_form`."""
    return F.exists(references, lambda r: label_form(predicted, source) == label_form(r, source))


def relaxed_number(text: Column) -> Column:
    """The number in a text with currency signs, thousands commas or a final percent sign."""
    return number(F.regexp_replace(F.regexp_replace(text, r"%\s*$", ""), r"[$€£,\s]", ""))


def relaxed(predicted: Column, references: Column, tolerance: float = 0.05) -> Column:
    """Numbers within the relative tolerance, other texts one inside the other; missing marks never."""
    p = F.lower(strip(predicted))

    def match(r: Column) -> Column:
        a, b, g = relaxed_number(predicted), relaxed_number(r), F.lower(strip(r))
        near = F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) < tolerance
        text = F.contains(g, p) | F.contains(p, g)
        void = p.isin(*MISSING) | g.isin(*MISSING)
        return F.when(void, False).when(a.isNotNull() & b.isNotNull(), near).otherwise(text)

    return F.exists(references, match)


def field_words(text: Column) -> Column:
    """Words of a text, or of the leaf values of JSON, without case, currency and punctuation."""
    trimmed = strip(text)
    values = F.regexp_replace(F.regexp_replace(trimmed, r'"[^"]*"\s*:', " "), r"[{}\[\]]", " ")
    leaves = F.when(trimmed.rlike(r"^[{\[]") & F.try_parse_json(trimmed).isNotNull(), values).otherwise(text)
    plain = F.regexp_replace(F.lower(F.regexp_replace(leaves, "[$€£¥₹,]", "")), PUNCTUATION, "")
    return F.filter(F.split(collapse(plain), " "), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Words of a text as it is, without case, currency and punctuation."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, "[$€£¥₹,]", "")), PUNCTUATION, "")
    return F.filter(F.split(collapse(plain), " "), lambda w: w != "")


def leaf_text(text: Column) -> Column:
    """The leaf values of JSON with spaces between, null as nothing; any other text as it is."""
    def told(value: object) -> str:
        if isinstance(value, dict | list):
            return " ".join(map(told, value.values() if isinstance(value, dict) else value))
        return "" if value is None else str(value)

    @F.pandas_udf("string")
    def leaves(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t and t.strip()[:1] in ("{", "["):
                try:
                    t = told(json.loads(t.strip()))
                except (ValueError, RecursionError):
                    pass
            out.append(t)
        return pd.Series(out, dtype=object)

    return leaves(text)


def shared(a: Column, b: Column) -> Column:
    """How many words two bags of words share."""
    def count(bag: Column, w: Column) -> Column:
        return F.size(F.filter(bag, lambda x: x == w))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def word_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two bags of words; 1 for two empty bags, 0 for one."""
    return bag_f1(field_words(F.coalesce(predicted, F.lit(""))), field_words(F.coalesce(reference, F.lit(""))))


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of two bags; 1 for two empty bags, 0 for one."""
    both = shared(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def box(text: Column) -> Column:
    """The first four numbers of a text as a box in the unit square, null if it is none."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"), 0), 1, 4), lambda x: x.cast("double"))
    x1, y1, x2, y2 = (F.get(found, i) for i in range(4))
    eps = 1e-6
    inside = (x1 >= -eps) & (y1 >= -eps) & (x2 <= 1 + eps) & (y2 <= 1 + eps)
    clipped = F.array(F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0)), F.least(x2, F.lit(1.0)), F.least(y2, F.lit(1.0)))
    return F.when((F.size(found) == 4) & inside & (x2 > x1) & (y2 > y1), clipped)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 if one is missing."""
    w = F.greatest(F.lit(0.0), F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1)))

    def area(x: Column) -> Column:
        return (F.get(x, 2) - F.get(x, 0)) * (F.get(x, 3) - F.get(x, 1))

    return F.coalesce(w * h / (area(a) + area(b) - w * h), F.lit(0.0))


def iou(predicted: Column, references: Column) -> Column:
    """The best overlap with any reference box."""
    return F.coalesce(F.array_max(F.transform(references, lambda r: overlap(box(predicted), box(r)))), F.lit(0.0))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one addition per word of ``b``.

    A bit of the state is 0 where the length grows at that word of ``a``.
    """
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    state = whole = (1 << len(a)) - 1
    for word in b:
        hit = state & places.get(word, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(a) - state.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(predicted: pd.Series, references: pd.Series) -> pd.Series:
    """The best F1 over the longest common subsequence of words, lower case; null without a reference."""
    def score(p: str | None, refs) -> float | None:
        if refs is None or not len(refs):
            return None
        best, a = 0.0, (p or "").lower().split()
        for r in refs:
            b = (r or "").lower().split()
            if not a and not b:
                return 1.0
            best = max(best, 2.0 * common_subsequence(a, b) / (len(a) + len(b)))
        return best

    return pd.Series([score(p, refs) for p, refs in zip(predicted, references, strict=True)], dtype="float64")


def date_form(text: Column) -> Column:
    """ISO form of a date: a year, year-month-day, month-day-year, or with the name of a month."""
    t = strip(text)
    ymd, mdy = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    named = r"^(?:(\d{1,2})\s+)?([A-Za-z]+)\.?\s*(\d{1,2})?,?\s*(\d{4})$"

    def two(form: str, i: int) -> Column:
        return F.lpad(F.regexp_extract(t, form, i), 2, "0")

    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, named, 2), 1, 3)))
    day = F.coalesce(*[F.nullif(F.regexp_extract(t, named, i), F.lit("")) for i in (1, 3)], F.lit("1"))
    long = F.concat_ws("-", F.regexp_extract(t, named, 4), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return (
        F.when(t.rlike(r"^\d{4}$"), t)
        .when(t.rlike(ymd), F.concat_ws("-", F.regexp_extract(t, ymd, 1), two(ymd, 2), two(ymd, 3)))
        .when(t.rlike(mdy), F.concat_ws("-", F.regexp_extract(t, mdy, 3), two(mdy, 1), two(mdy, 2)))
        .when(t.rlike(named) & (month > 0), long)
    )


def short_number(n: Column) -> Column:
    """A whole number without a point, any other to six significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(n))))
    return F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise((F.rint(n * scale) / scale).cast("string"))


def value_form(text: Column) -> Column:
    """A number to six significant digits, a date in ISO form, or the lower-case text."""
    t = strip(text)
    n = number(F.regexp_replace(t, "[,$€£¥]", ""))
    return F.coalesce(F.when(n.isNotNull(), short_number(n)), date_form(t), F.lower(t))


def answer_form(text: Column) -> Column:
    """The sorted values of an answer; a date or an answer without separators is one value."""
    t = strip(F.coalesce(text, F.lit("")))
    listed = F.contains(t, F.lit(";")) | F.contains(F.regexp_replace(t, r"\d,\d", ""), F.lit(","))
    parts = F.filter(F.split(t, r"[;,]\s*"), lambda p: strip(p) != "")
    many = F.array_sort(F.transform(parts, value_form))
    return F.when(date_form(t).isNotNull(), F.array(F.lit("one"), date_form(t))).when(listed, F.concat(F.array(F.lit("many")), many)).otherwise(F.array(F.lit("one"), value_form(t)))


def denotation(predicted: Column, references: Column) -> Column:
    """Whether the prediction denotes the same values as any reference, in any order."""
    return F.exists(references, lambda r: answer_form(predicted) == answer_form(r))


def spoken_form(text: Column) -> Column:
    """Words without articles and punctuation; numbers in short form."""
    raw = F.filter(F.split(F.lower(strip(F.coalesce(text, F.lit("")))), r"\s+"), lambda w: w != "")

    def clean(w: Column) -> Column:
        n = number(w)
        return F.when(n.isNotNull(), F.array(short_number(n))).otherwise(F.split(collapse(F.regexp_replace(w, r"[^\p{L}\p{N}_\s]", " ")), " "))

    return F.array_join(F.filter(F.flatten(F.transform(raw, clean)), lambda w: ~w.isin("", "a", "an", "the")), " ")


def vqa(predicted: Column, annotators: Column, agree: int = 3) -> Column:
    """A third for each annotator that gave the answer, at most 1; repeated answers are several annotators."""
    same = F.size(F.filter(annotators, lambda a: spoken_form(a) == spoken_form(predicted)))
    return F.least(same / float(agree), F.lit(1.0))


def vqa_correct(predicted: Column, annotators: Column, agree: int = 3) -> Column:
    """Whether three annotators gave the answer, or all of them where there are fewer than three.

    The rule of three has nothing to say of a sample with one gold answer: equality decides there.
    """
    same = F.size(F.filter(annotators, lambda a: spoken_form(a) == spoken_form(predicted)))
    return (F.size(annotators) > 0) & (same >= F.least(F.lit(agree), F.size(annotators)))


def slide_number(text: Column) -> Column:
    """The number in a text with currency, percent or about signs."""
    return number(strip(F.regexp_replace(text, "[,$€£%~]", "")))


def slide(predicted: Column, reference: Column, question: Column) -> Column:
    """Numbers within 5 %, inclusive, where both are numbers or the question counts; else equality."""
    a, b = slide_number(predicted), slide_number(reference)
    same = F.lower(strip(predicted)) == F.lower(strip(reference))
    near = F.when(b == 0, F.abs(a) <= 0.05).otherwise(F.abs(a - b) <= 0.05 * F.abs(b))
    counts = F.coalesce(question, F.lit("")).rlike(r"(?i)\b(total|sum|average|mean|how\s+many|count|add|combined|altogether)\b")
    both = a.isNotNull() & b.isNotNull()
    return F.when((counts | both) & both, near).otherwise(same)


@F.pandas_udf(T.DoubleType())
def table_similarity(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """1 - tree distance / larger tree; 1 for equal texts, 0 for a missing one."""
    def score(p: str | None, r: str | None) -> float:
        if p is None or r is None:
            return 0.0
        if p.strip() == r.strip():
            return 1.0
        x, y = read_tree(p), read_tree(r)
        return max(0.0, 1.0 - tree_distance(x, y) / max(tree_size(x), tree_size(y)))

    return pd.Series([score(p, r) for p, r in zip(predicted, reference, strict=True)])


@F.pandas_udf(T.DoubleType())
def rough_table_similarity(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    """Similarity of tables by rows and cells or by words, where trees are not wanted; 0 for a missing one."""
    return pd.Series([0.0 if p is None or r is None else 1.0 if p.strip() == r.strip() else rough_similarity(p, r) for p, r in zip(predicted, reference, strict=True)])


#: The scores from which an answer is correct.
THRESHOLDS = {"anls": 0.5, "field_f1": 0.5, "iou": 0.25, "rouge_cider": 0.5, "teds": 0.7}


def answers(reference: Column, aliases: Column) -> Column:
    """The gold answer and its aliases as they are given, repeated ones too; nulls are none."""
    return F.array_compact(F.concat(F.array(reference), F.coalesce(aliases, F.array().cast("array<string>"))))


def is_correct(metric: Column, predicted: Column, reference: Column, aliases: Column, source: Column, question: Column) -> Column:
    """Whether a prediction is correct under the metric of that name, in any case of letters.

    A null prediction is wrong; an unknown metric raises.  Tables and slides are compared with the
    first answer, all others with every one; the answers of annotators count as often as given.
    What Python has to score is only passed the pairs of its own metric.
    """
    given = answers(reference, aliases)
    many = F.array_distinct(given)
    name = F.lower(strip(metric))

    def mine(own: str, value: Column) -> Column:
        return F.when(name == own, value)

    fields = F.transform(many, lambda r: word_f1(predicted, r))
    wrong = F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce(metric, F.lit("null"))))
    told = (
        F.when(name == "anls", anls(predicted, many) >= THRESHOLDS["anls"])
        .when(name == "exact_match", exact(predicted, many, source))
        .when(name == "relaxed_accuracy", relaxed(predicted, many))
        .when(name == "field_f1", F.coalesce(F.array_max(fields), F.lit(0.0)) >= THRESHOLDS["field_f1"])
        .when(name == "iou", iou(predicted, many) >= THRESHOLDS["iou"])
        .when(name == "rouge_cider", F.coalesce(rouge_l(mine("rouge_cider", predicted), mine("rouge_cider", many)), F.lit(0.0)) >= THRESHOLDS["rouge_cider"])
        .when(name == "denotation", denotation(predicted, many))
        .when(name == "vqa_accuracy", vqa_correct(predicted, given))
        .when(name == "slidevqa_em", slide(predicted, reference, question))
        .when(name == "teds", table_similarity(mine("teds", predicted), mine("teds", reference)) >= THRESHOLDS["teds"])
        .otherwise(wrong.cast("boolean"))
    )
    return F.when(predicted.isNull() | reference.isNull(), False).otherwise(F.coalesce(told, F.lit(False)))
