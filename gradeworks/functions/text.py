"""Text expressions: keys, keyword tests, answer extraction and structured responses."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII punctuation marks.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
#: Answers of two classes, after which an explanation may follow.
BINARY = ("yes", "no", "true", "false", "entailed", "refuted")
#: Scores of the labels in structured responses.
LEVELS = {
    "visual": {"TEXT_ONLY": 1, "LAYOUT": 2, "VISUAL": 3, "CROSS_MODAL": 4},
    "reasoning": {"LOOKUP": 1, "SIMPLE": 2, "MULTI_STEP": 3, "COMPLEX": 4},
    "extent": {"SINGLE": 1, "REGION": 2, "MULTI_REGION": 3, "MULTI_PAGE": 4},
}


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Stripped, with single spaces."""
    return F.regexp_replace(strip(text), r"\s+", " ")


def query_form(query: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces; null counts as empty."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), PUNCTUATION, ""))


def text_key(query: Column) -> Column:
    """MD5 of :func:`query_form`."""
    return F.md5(query_form(query))


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any keyword, as a substring."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for word in keywords:
        out = out | F.contains(low, F.lit(word))
    return out


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def sample_id(name: Column, split: Column, index: Column, digits: int = 8) -> Column:
    """``name_split_00000042``."""
    return F.concat_ws("_", name, split, F.lpad(index.cast("string"), digits, "0"))


def canonical_name(name: Column) -> Column:
    """Source names without case, spaces, hyphens and underscores."""
    return F.regexp_replace(F.lower(name), r"[\s\-_]+", "")


def hex_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex hashes, 999 where one is no such hash."""
    def bits(h: Column) -> Column:
        good = h.rlike("^[0-9a-fA-F]{1,16}$")
        return F.when(good, F.conv(h, 16, -10).cast("long"))

    return F.coalesce(F.bit_count(bits(a).bitwiseXOR(bits(b))), F.lit(999))


def without_thinking(text: Column) -> Column:
    """The text without ``<think>`` blocks."""
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def thinking_tokens(text: Column) -> Column:
    """A quarter of the characters inside ``<think>`` blocks, rounded down."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<think>(.*?)</think>"), 1)
    return F.coalesce(F.floor(F.length(F.array_join(blocks, "")) / 4), F.lit(0)).cast("int")


def cut_explanation(text: Column) -> Column:
    """A binary answer without what follows its first mark; other texts as they are."""
    head = strip(F.regexp_extract(text, r"^([^,.;!?]*)[,.;!?]", 1))
    return F.when(F.lower(head).isin(*BINARY), head).otherwise(text)


def extract_answer(raw: Column) -> Column:
    """The answer in a raw response.

    Thinking blocks and emphasis go; a JSON object with an ``answer`` gives that; else the first
    line with text counts, without an introduction, quotes or, after yes and no, an explanation.
    """
    text = strip(F.regexp_replace(without_thinking(F.coalesce(raw, F.lit(""))), r"\*\*|__", ""))
    boxed = F.when(text.startswith("{"), F.get_json_object(text, "$.answer"))
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: x != ""), 0), F.lit(""))
    bare = line
    for form in (r"(?i)^(?:the\s+)?(?:final\s+)?answer\s*(?:is\s*:?|:)\s*", r"(?i)^ans(?:wer)?\s*:\s*", r"(?i)^a\s*:\s*", r"(?i)^looking at (?:the )?[^,]{1,60},\s*", r"(?i)^(?:based on|according to) [^,]{1,60},\s*", r"(?i)^(?:it is|this is|that is)\s+", r"(?i)^result\s*:\s*"):
        bare = F.regexp_replace(bare, form, "")
    bare = cut_explanation(strip(bare))
    return F.regexp_replace(F.coalesce(boxed, bare), r"""^["'`]+|["'`]+$""", "")


def label_and_evidence(raw: Column) -> Column:
    """``label`` (upper case, underscores) and ``evidence`` around the first vertical bar."""
    parts = F.split(raw, r"\|", 2)
    return F.struct(F.regexp_replace(F.upper(strip(F.get(parts, 0))), " ", "_").alias("label"), F.coalesce(strip(F.get(parts, 1)), F.lit("")).alias("evidence"))


def tagged_line(text: Column, tag: str) -> Column:
    """What follows ``TAG:`` on the last line that starts with it; null without one."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda x: F.upper(x).startswith(f"{tag}:"))
    return strip(F.substring(F.try_element_at(lines, F.lit(-1)), len(tag) + 2, 1 << 30))


def structured_response(raw: Column) -> Column:
    """A response of tagged lines as a struct: answer, document type, elements and three scores.

    The last line of a tag counts; unknown and missing labels score 2.
    """
    def score(tag: str, axis: str) -> Column:
        label = label_and_evidence(tagged_line(raw, tag))["label"]
        out = F.lit(2)
        for name, value in LEVELS[axis].items():
            out = F.when(label == name, F.lit(value)).otherwise(out)
        return out

    elements = F.filter(F.transform(F.split(F.coalesce(tagged_line(raw, "ELEMENTS"), F.lit("")), ","), lambda x: F.lower(strip(x))), lambda x: ~x.isin("", "none"))
    return F.struct(
        F.coalesce(tagged_line(raw, "ANSWER"), F.lit("")).alias("answer"),
        F.lower(F.coalesce(tagged_line(raw, "TYPE"), F.lit("unknown"))).alias("doc_type"),
        elements.alias("elements"),
        score("VISUAL", "visual").alias("vds"),
        score("REASONING", "reasoning").alias("rds"),
        score("EXTENT", "extent").alias("ses"),
    )


def _leaves_of(value: object, path: str) -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _leaves_of(v, f"{path}.{k}" if path else k)]
    told = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return [(path, told.strip())] if value is not None and told.strip() else []


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_leaves(documents: pd.Series) -> pd.Series:
    """Map of dotted paths to the leaf values of a JSON object of any depth.

    Numbers stay as they are written and arrays as JSON text; blank and null leaves are dropped, and
    what is no JSON object has no leaves, so null.
    """
    def leaves(text: str | None) -> dict[str, str] | None:
        try:
            value = None if text is None else json.loads(text, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            return None
        return dict(_leaves_of(value, "")) if isinstance(value, dict) else None

    return pd.Series([leaves(t) for t in documents], dtype=object)
