"""Evaluation texts leaking into training text (problem 8).

The normalised word n-grams of all held-out passages form a hash set, which is broadcast; the
windows of every document are looked up in it, hits on one diagonal are gathered, and each
candidate is verified by a local alignment of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import materialize, small_enough
from .text import word_places, words

N = 6
#: Scores of the alignment: a pair of equal words, of different words, a word without partner.
#: Another word where a slip is ruled out costs more than the words between two names or numbers.
EQUAL, OTHER, GAP = 1.0, -6.0, -4.0
#: Documents whose words are held in memory at once.
SLICE = 500
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

LEAK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("last_word", T.IntegerType()),
    ]
)


def word_codes(tokens: list[str]) -> np.ndarray:
    """A 64-bit code of each word."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True)


def windows(codes: np.ndarray, n: int = N) -> np.ndarray:
    """A 64-bit code of each window of ``n`` words."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ codes[k : len(out) + k]) * MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """The held-out passages: their words in one text each, and their windows sorted by code."""

    ids: list[int]
    texts: list[str]
    size: np.ndarray
    codes: np.ndarray
    item: np.ndarray
    position: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str]], n: int = N) -> Index:
        tokens = [words(p) for _, p in items]
        grams = [windows(word_codes(t), n) for t in tokens]
        codes = np.concatenate([*grams, np.empty(0, dtype=np.uint64)])
        order = np.argsort(codes, kind="stable")
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        position = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, dtype=np.int64)])
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        return cls([i for i, _ in items], [" ".join(t) for t in tokens], size, codes[order], item[order], position[order])


def near(a: str, b: str) -> bool:
    """Whether two words differ by a slip: up to one edit, two in words of eight letters and more.

    Numbers have no slips: another number is another number.
    """
    short, long = sorted((a, b), key=len)
    allowed = 2 if len(short) >= 8 else 1
    if len(short) < 3 or len(long) - len(short) > allowed or (short[0] != long[0] and short[-1] != long[-1]) or 2 * sum(c.isdigit() for c in short) >= len(short):
        return False
    row = list(range(len(short) + 1))
    for i, y in enumerate(long, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(short, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= allowed


def align(passage: list[str], stretch: list[str], drop: float = 30.0) -> tuple[int, int, int]:
    """Words of the passage that the best local alignment repeats, and where it lies in the stretch.

    Only cells above 0 are kept, row by row, and of a row only those within ``drop`` of its best:
    an alignment that has lost so much more than another is not the one sought.
    """
    places: dict[str, list[int]] = {}
    for j, word in enumerate(stretch, 1):
        places.setdefault(word, []).append(j)
    cols = len(stretch)
    best, at = 0.0, (0, 0)
    steps: list[dict[int, int]] = [{}]
    up: dict[int, float] = {}
    lead = 0.0
    alike: dict[tuple[str, str], bool] = {}
    for i, word in enumerate(passage, 1):
        here: dict[int, float] = {}
        mark: dict[int, int] = {}
        for j in places.get(word, ()):
            here[j], mark[j] = up.get(j - 1, 0.0) + EQUAL, 1
        for j, score in up.items():
            if j < cols and j + 1 not in mark:
                same = False
                if score > 3 and score > lead - 9:
                    other = stretch[j]
                    same = alike.get((word, other))
                    if same is None:
                        same = alike[word, other] = near(word, other)
                value = score + (EQUAL if same else OTHER)
                if value > 0 and value > here.get(j + 1, 0.0):
                    here[j + 1], mark[j + 1] = value, 1 if same else 2
            if score + GAP > here.get(j, 0.0):
                here[j], mark[j] = score + GAP, 3
        lead = max(here.values(), default=0.0)
        for j in sorted(here):
            value = here[j] + GAP
            while j < cols and value > here.get(j + 1, 0.0) and value > lead - drop:
                j += 1
                here[j], mark[j] = value, 4
                value += GAP
        if lead > drop:
            here = {j: v for j, v in here.items() if v > lead - drop}
        if lead > best:
            best, at = lead, (i, max(j for j, v in here.items() if v == lead))
        steps.append(mark)
        up = here
    i, j = at
    equal, last = 0, j
    while i and j and j in steps[i]:
        m = steps[i][j]
        equal += m == 1
        i, j = i - (m != 4), j - (m != 3)
    return equal, j, last


def candidates(item: np.ndarray, position: np.ndarray, place: np.ndarray, doc: np.ndarray, size: np.ndarray, share: float, drift: int, n: int = N, cover: float = 0.6) -> Iterator[tuple[int, int, int]]:
    """``(document, item, diagonal)`` worth an alignment, from hits of windows.

    A repeated stretch leaves its hits within ``drift`` of one diagonal, however often a word was
    split or lost between them.  Somewhere in the passage as many words in a row as a case needs
    must be covered by such hits to the part ``cover``: slips leave more whole windows than that,
    sentences that are only built alike, with other names and numbers, far fewer.  Windows of
    diagonals within ``drift`` of a better one of the same pair are left to it.
    """
    diagonal = place - position
    order = np.lexsort((diagonal, item, doc))
    item, doc, diagonal, position = item[order], doc[order], diagonal[order], position[order]
    span = int(diagonal.max() - diagonal.min()) + 2 * drift + 2
    pair = doc * len(size) + item
    key = pair * span + (diagonal - diagonal.min())
    ends = np.searchsorted(key, key + drift, side="right")
    hits = ends - np.arange(len(key))
    good = np.flatnonzero(hits >= np.maximum(2, 0.3 * share * size[item]))
    taken: dict[int, list[int]] = {}
    for k in good[np.argsort(-hits[good], kind="stable")].tolist():
        used = taken.setdefault(int(pair[k]), [])
        d = int(diagonal[k])
        if any(abs(d - u) <= drift for u in used):
            continue
        length = int(size[item[k]])
        need = max(1, int(share * length))
        marks = np.zeros(length + 1, dtype=np.int64)
        at = position[k : ends[k]]
        for j in range(n):
            marks[at + j + 1] = 1
        sums = np.cumsum(marks)
        if (sums[need:] - sums[: length + 1 - need]).max() >= cover * need:
            used.append(d)
            yield int(doc[k]), int(item[k]), d


def _stretches(passage: list[str], text: list[str], start: int, stop: int, share: float) -> Iterator[tuple[float, int, int]]:
    """Every stretch between two words of a text that repeats ``share`` of a passage: share, first and last word.

    The best alignment comes first; what lies before and after it is searched again.
    """
    if stop - start < share * len(passage):
        return
    equal, first, last = align(passage, text[start:stop])
    if equal >= share * len(passage) and last > first:
        yield equal / len(passage), start + first, start + last - 1
        yield from _stretches(passage, text, start, start + first, share)
        yield from _stretches(passage, text, start + last, stop, share)


def _scan(tokens: list[list[str]], index: Index, share: float, drift: int, n: int) -> list[tuple[int, int, float, int, int]]:
    """Every stretch of a text that leaks a passage: text, passage, share, first and last word."""
    lengths = np.fromiter((len(t) for t in tokens), dtype=np.int64, count=len(tokens))
    codes = windows(word_codes([w for t in tokens for w in t]), n)
    if not len(codes) or not len(index.codes):
        return []
    low = np.searchsorted(index.codes, codes, side="left")
    hit = np.flatnonzero(index.codes[np.minimum(low, len(index.codes) - 1)] == codes)
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, hit, side="right")
    inside = hit + n <= ends[doc]
    hit, doc = hit[inside], doc[inside]
    if not len(hit):
        return []
    low, high = low[hit], np.searchsorted(index.codes, codes[hit], side="right")
    count = high - low
    entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(hit - (ends - lengths)[doc], count)
    found: dict[tuple[int, int, int, int], float] = {}
    for d, i, diagonal in candidates(index.item[entry], index.position[entry], place, np.repeat(doc, count), index.size, share, drift, n):
        passage, text = index.texts[i].split(" "), tokens[d]
        start = max(0, diagonal - drift)
        for part, first, last in _stretches(passage, text, start, min(len(text), diagonal + len(passage) + 2 * drift), share):
            found[d, i, first, last] = max(part, found.get((d, i, first, last), 0.0))
    return [(d, i, part, first, last) for (d, i, first, last), part in found.items()]


def _blocks(items: DataFrame, block_words: int, n: int) -> Iterator[Index]:
    """Indexes of the held-out passages, dealt by hash into blocks of about ``block_words`` words."""
    held = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "passage").distinct()
    total = held.agg(F.sum(F.regexp_count("passage", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    if blocks > 1:
        held = materialize(held, "heldout")
    for b in range(blocks):
        own = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b)
        yield Index.build(sorted((r[0], r[1]) for r in own.collect()), n)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, block_words: int = 2_000_000, drift: int = 8, n: int = N) -> DataFrame:
    """Every stretch of a document that repeats at least ``share`` of the words of a held-out item.

    One row per stretch, with the share and the words of the document it covers; a document that
    holds a passage twice has two.  Null and blank texts and passages, and passages of fewer than
    ``n`` words, have no cases.  The index takes about 32 bytes per held-out word and is broadcast in
    blocks of about ``block_words`` words, a passage never being split: a set of items beyond one
    block is searched block by block, each in one pass over whole texts.  Nothing but the stretches
    found is shuffled.
    """
    spark = documents.sparkSession
    blocks = _blocks(items, block_words, n)
    built, following = next(blocks), next(blocks, None)
    out: DataFrame | None = None
    single = following is None
    while built is not None:
        # As plain lists and arrays, since a broadcast travels without this package.
        shared = spark.sparkContext.broadcast(tuple(vars(built).values()))
        found = _texts(documents).mapInPandas(_finder(shared, share, drift, n), LEAK)
        if not single:
            found = materialize(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
        built, following = following, next(blocks, None)
    return out.distinct()


def _finder(shared, share: float, drift: int, n: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                found = _scan([words(t) for t in frame["text"].iloc[at : at + SLICE]], index, share, drift, n)
                if found:
                    ids = frame["doc_id"].iloc[at : at + SLICE].to_numpy()
                    yield pd.DataFrame([(ids[d], index.ids[i], *v) for d, i, *v in found], columns=LEAK.names)

    return scan


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text without the words of the ranges (first, last), which may overlap; all else stays as it is."""
    places = word_places(text)
    out, at, reach = [], 0, -1
    for first, last in sorted(ranges):
        first = max(first, reach + 1)
        if first > last:
            continue
        out.append(text[at : places[first][0]])
        at, reach = places[last][1], last
    return "".join([*out, text[at:]])


def remove_spans(documents: DataFrame, found: DataFrame, most: int = 200_000) -> DataFrame:
    """``documents`` without the stretches of ``found``; every other character of a text stays.

    Stretches that overlap are cut once.  The stretches are broadcast if at most ``most`` documents
    have any, so that no text is shuffled; beyond that the tables are joined by document.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "last_word")).alias("__spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None or not len(r) else cut_words(t, [(x["first_word"], x["last_word"]) for x in r]) for t, r in zip(text, spans, strict=True)], dtype=object)

    spans = spans.withColumnRenamed("doc_id", "__doc")
    joined = documents.join(F.broadcast(spans) if small_enough(spans, most) else spans, F.col("doc_id") == F.col("__doc"), "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNotNull(), cut("text", "__spans")).otherwise(F.col("text"))).select(*documents.columns)


def clean(documents: DataFrame, items: DataFrame, share: float = 0.4, block_words: int = 2_000_000, drift: int = 8, n: int = N) -> DataFrame:
    """``(doc_id, text)`` of all documents, without what they leak of the items.

    A text is scanned and cut where it is read, again and again until it leaks nothing: what moves
    together by a cut is seen too.  Texts without a leak stay as they are, null ones null.  More
    items than one block are cut block by block in the same way, until no block finds anything.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("cuts", T.IntegerType())])

    def cutter(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(*shared.value)
            for frame in frames:
                texts, cuts = list(frame["text"]), np.zeros(len(frame), dtype=np.int32)
                for at in range(0, len(texts), SLICE):
                    open_ = [k for k in range(at, min(len(texts), at + SLICE)) if texts[k]]
                    while open_:
                        ranges: dict[int, list[tuple[int, int]]] = {}
                        for d, _, _, first, last in _scan([words(texts[k]) for k in open_], index, share, drift, n):
                            ranges.setdefault(open_[d], []).append((first, last))
                        for k, r in ranges.items():
                            texts[k], cuts[k] = cut_words(texts[k], r), cuts[k] + 1
                        open_ = list(ranges)
                yield pd.DataFrame({"doc_id": frame["doc_id"], "text": pd.Series(texts, index=frame.index, dtype=object), "cuts": cuts})

        return run

    blocks = _blocks(items, block_words, n)
    built, following = next(blocks), next(blocks, None)
    if following is None:
        return rows.mapInPandas(cutter(spark.sparkContext.broadcast(tuple(vars(built).values()))), schema).drop("cuts")
    again = True
    while again:
        again = False
        while built is not None:
            shared = spark.sparkContext.broadcast(tuple(vars(built).values()))
            done = materialize(rows.mapInPandas(cutter(shared), schema), "cleaned")
            shared.destroy()
            again = again or not done.where("cuts > 0").isEmpty()
            rows, built, following = done.drop("cuts"), following, next(blocks, None)
        if again:
            blocks = _blocks(items, block_words, n)
            built, following = next(blocks), next(blocks, None)
    return rows
