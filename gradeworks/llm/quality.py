"""Per-document text quality statistics, and the kind of a document (problem 9).

Huge documents are split into chunks.  Each chunk gives counts that only ever add up; the state at
its boundaries (was a line or a word cut there, what line came before) corrects them, so that the
counts are the same for chunks of any size.  Counts are summed per document in a tree of partial
aggregates; ratios are derived from the sums, and the kind of a document from the ratios.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import materialize

#: Frequent function words by language.
COMMON = {
    "en": "the a an of and to in that was it is for on with as from which has had be by at this but not are were or its if there one they would both their than so who he she we you his her have been",
    "de": "der die das und ist ein eine einer im in den dem des von zu mit auf für sich nicht als auch an wird war aus bei nach noch hat wir wer zum zur sind oder über aber keine kein",
    "fr": "le la les des du de un une et est en que qui dans pour pas sur au aux par plus ne se ce cette il elle nous avec sont été mais avons ou son sa ses",
    "es": "el la los las de del un una y es en que por con no se su al lo como más para fue hemos sin pero o este esta quien ya muy",
    "it": "il lo la gli le di del della un una e è in che per con non si su da al come più sono ma questo questa alla nel",
    "pt": "o os as de do da dos das um uma e em que por com não se na no ao como mais para foi são mas este esta",
    "nl": "de het een en van is in dat op te voor met niet zijn aan er om maar bij ook als dan naar",
    "ru": "и в на не что с по для как но из у за от это к мы его а же так был была были при о до если или ещё нет их её кто тот эта этой потому перед рядом раз нам",
}
WORDS = frozenset(w for words in COMMON.values() for w in words.split())

_LETTERS = re.compile(r"[^\W\d_]+")
_TABLE_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_LIST_TAG = re.compile(r"</?(?:li|ul|ol|dt|dd)\b", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_RULE = re.compile(r"[|+\-=:_ ─│┼╔╗╚╝║═*]+")
_BULLET = re.compile(r"(?:[*•·▪◦‣○●■□☐☑✓✗→>+–—-]+\s+|\[[ xX]?\]\s+|\(?(?:\d{1,4}|[a-zA-Z]|[ivxlcIVXLC]{1,7})[.)]\s+|#\d+\s+)(?=\S)")
_FIELD = re.compile(r"[^\W\d_][^:=.!?]{0,48}?\s*(?::|=|\.{3,}|\s->)\s*\S")
_GAP = re.compile(r"\S(?: {3,}| *\t *)(?=\S)")
_UNSPOKEN = re.compile(r"[^aeiouyäöüàâéèêëîïôûùáíóúñãõåæøаеёиоуыэюя\W\d_]{5,}")
_CODED = re.compile(r"(?=[^\s]*\d)[0-9a-fA-F]{8,}|[A-Za-z0-9+/=]{24,}")
_MANGLED = re.compile(r"[ÃÂ�ï¿½]|â€")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_EDGE = ".,;:!?…\"'`()[]{}<>«»“”„’*#>|"
_END = tuple(".!?…:;\"'”»)]。！？」")
_RUN = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…。！？](?=[\s\"'”»)]|$)")

COUNTS = ("chars", "words", "word_chars", "common", "digits", "symbols", "lines", "ended", "prose", "list", "table", "junk")
PIECE = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])


def kind_of_line(line: str, words: list[str], common: int, visible: int, symbols: int) -> str:
    """``prose``, ``list``, ``table``, ``junk``, or ``short``: what one line by itself looks like.

    A short line without marks is an item, unless the line before it leaves a sentence open.
    """
    count = len(words)
    share = common / count if count else 0.0
    if "<" in line:
        if _TABLE_TAG.search(line):
            return "table"
        if _LIST_TAG.search(line):
            return "list"
    if _RULE.fullmatch(line):
        return "table" if ("|" in line or "│" in line) and ("-" in line or "─" in line or "=" in line) else "junk"
    if not count and symbols == visible:
        return "junk"
    mangled = len(_MANGLED.findall(line))
    if mangled * 8 > visible:
        return "junk"
    if len(_CJK.findall(line)) * 3 > visible:
        return "list" if visible < 40 and _BULLET.match(line) else "prose"
    tokens = line.split()
    some = len(tokens)
    if visible >= 24 and visible > 7 * some and sum(len(x) for x in _CODED.findall(line)) * 2 > visible:
        return "junk"
    pipes = line.count("|") + line.count("│")
    speaks = share >= 0.2 and common >= 2
    bars = symbols - pipes - line.count(";") - line.count(",") - line.count("&") - line.count("\\")
    noisy = visible > 12 and bars * 4 > visible and share < 0.2
    if not noisy and visible > 12 and symbols * 5 > visible:
        runs = _RUN.findall(line)
        noisy = len(runs) >= 4 and sum(map(len, runs)) * 2 < 5 * len(runs) and 4 * sum(map(str.isdigit, line)) < visible
    latex = line.endswith("\\\\") and line.count("&") >= 1
    if not noisy and share < 0.3 and (pipes >= 2 or line.count("\t") >= 1 or latex or (pipes == 1 and " | " in f" {line} ")):
        return "table"
    bullet = _BULLET.match(line)
    if bullet and not noisy:
        if count <= 12 and not (speaks and count >= 7 and share >= 0.3):
            return "list"
    if speaks and not noisy:
        if count >= 24 and len(set(words)) < min(12, count / 5):
            return "junk"
        return "prose"
    if not noisy and share < 0.2 and ((line.count(",") >= 2 and ", " not in line and line.count(",") * 4 >= some) or (line.count(";") >= 2 and "; " not in line)):
        return "table"
    if not noisy and share < 0.2 and some >= 2 and _GAP.search(line) and len(_GAP.findall(line)) >= 1:
        return "table"
    unspoken = sum(1 for w in words if _UNSPOKEN.search(w))
    if noisy or (count >= 3 and unspoken * 4 > count):
        return "junk"
    if some >= 8:
        single = sum(1 for t in tokens if len(t) == 1)
        marked = sum(1 for t in tokens if t[-1] in "@_/#~^|\\")
        if single * 2 > some or marked * 5 > some or len(set(tokens)) * 3 < some:
            return "junk"
    if _FIELD.match(line) and some <= 16:
        return "list"
    if some <= 10:
        return "short"
    # Words of a language without known function words: sentences have ends and few repeats.
    ends = len(_STOP.findall(line))
    if count >= 5 and ends and count <= 45 * ends and len(set(words)) * 2 >= count and symbols * 6 < visible:
        return "prose"
    return "junk"


def measure(raw: str) -> tuple[str, list[str], int, int, int, int, str]:
    """A line without white space around it, its words, and what is counted of it, with its kind."""
    line = (html.unescape(raw) if "&" in raw and ";" in raw else raw).strip()
    if not line:
        return "", [], 0, 0, 0, 0, ""
    bare = _TAG.sub(" ", line) if "<" in line else line
    words = _LETTERS.findall(bare.lower())
    # Only whole tokens count: the letters of a code or a hash are no function words.
    common = sum(map(WORDS.__contains__, [t.strip(_EDGE) for t in bare.lower().split()]))
    visible = len("".join(line.split()))
    digits = sum(map(str.isdigit, line)) if not line.isalpha() else 0
    symbols = max(0, visible - sum(map(len, words)) - digits - (len(line) - len(bare)))
    return line, words, common, visible, digits, symbols, kind_of_line(line, words, common, visible, symbols)


#: A line longer than this is measured in segments of this length, counted from where it starts.
SEGMENT = 2048


def segments(raw: str) -> list[str]:
    """A line as one part, or cut every :data:`SEGMENT` characters."""
    return [raw] if len(raw) <= SEGMENT else [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


def piece_counts(text: str, starts_mid_line: bool = False, starts_mid_word: bool = False, ends_mid_line: bool = False, before: str = "") -> list[int]:
    """The counts of one chunk; a cut line counts once, and so does a cut word.

    ``before`` is the line before the chunk, or its last segment, which tells whether a sentence is open.
    """
    total = dict.fromkeys(COUNTS, 0)
    lines = text.split("\n")
    last, *_, kind = measure(before)
    is_open = kind == "prose" and not last.endswith(_END)
    for number, raw in enumerate(lines):
        parts = segments(raw)
        for k, part in enumerate(parts):
            line, words, common, visible, digits, symbols, kind = measure(part)
            if not line:
                is_open = False
                continue
            inside = k > 0 or (number == 0 and starts_mid_line)
            total["chars"] += visible
            total["words"] += len(words) - (k > 0 and parts[k - 1][-1].isalpha() and part[0].isalpha())
            total["word_chars"] += sum(map(len, words))
            total["common"] += common
            total["digits"] += digits
            total["symbols"] += symbols
            total["lines"] += not inside
            total["ended"] += k == len(parts) - 1 and line.endswith(_END) and not (ends_mid_line and number == len(lines) - 1)
            total["prose" if kind == "short" and is_open else "list" if kind == "short" else kind] += visible
            is_open = kind == "prose" and not line.endswith(_END)
    if starts_mid_word:
        total["words"] -= 1
    return [int(total[c]) for c in COUNTS]


def chunks(text: str, size: int) -> Iterator[tuple[str, bool, bool, bool, str]]:
    """``(chunk, starts mid line, starts mid word, ends mid line, line before)`` of a text, in order.

    A chunk ends after the last line break among its last :data:`SEGMENT` characters, else at the
    last end of a segment of the line it is in, so no segment is ever cut.
    """
    size = max(size, 2 * SEGMENT)
    at, start, mid_word = 0, 0, False
    while at < len(text):
        end = min(len(text), at + size)
        cut, line = end, max(start, text.rfind("\n", at, end) + 1)
        if end < len(text):
            broken = text.rfind("\n", max(at, end - SEGMENT), end) + 1
            cut = broken or line + (end - line) // SEGMENT * SEGMENT
        before = ""
        if at:
            stop = at if at > start else at - 1
            own = start if at > start else text.rfind("\n", 0, stop) + 1
            before = text[own + max(0, stop - own - 1) // SEGMENT * SEGMENT : stop]
        mid_line = at > start
        ends_line = cut >= len(text) or text[cut - 1] == "\n"
        yield text[at:cut], mid_line, mid_word, not ends_line, before
        start = cut if ends_line else line
        mid_word = not ends_line and text[cut - 1].isalpha() and text[cut].isalpha()
        at = cut


def counts(documents: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``doc_id`` and the summed :data:`COUNTS` of every document; null and blank texts count 0.

    Texts are read once.  One of at most ``chunk`` characters is counted where it is read; longer
    ones are cut there, their chunks are dealt over all tasks, and the counts are added up by
    partial aggregation, so a text of any size costs each task about a chunk at a time.  Between lie
    a table of the counts and of the chunks of long texts in the shared folder.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    extra = [T.StructField("text", T.StringType()), *[T.StructField(c, T.BooleanType()) for c in ("mid_line", "mid_word", "ends_mid_line")], T.StructField("before", T.StringType())]
    read_schema = T.StructType([*PIECE.fields, *extra])
    blank, none = [None] * len(extra), [None] * len(COUNTS)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, t in zip(frame["doc_id"], frame["text"], strict=True):
                if len(t) <= chunk:
                    out.append((i, *piece_counts(t), *blank))
                    continue
                for c in chunks(t, chunk):
                    out.append((i, *none, *c))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=read_schema.names).astype(dict.fromkeys(COUNTS, "Int64"))
                        out = []
            yield pd.DataFrame(out, columns=read_schema.names).astype(dict.fromkeys(COUNTS, "Int64"))

    def count_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r.doc_id, *piece_counts(r.text, r.mid_line, r.mid_word, r.ends_mid_line, r.before)) for r in frame.itertuples()], columns=PIECE.names)

    read = materialize(rows.mapInPandas(count, read_schema), "counted")
    pieces = read.where("text is not null").select("doc_id", *[f.name for f in extra])
    large = pieces.repartition(F.xxhash64("text", "doc_id")).mapInPandas(count_pieces, PIECE)
    large = large.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return read.where("text is null").select(*PIECE.names).unionByName(large)


def kind(prose: Column, listed: Column, table: Column, junk: Column) -> Column:
    """The rule on a document's shares: the largest part that is not prose, where such parts hold more than half; else null."""
    other = F.greatest(listed, table, junk)
    named = F.when(other == junk, "junk").when(other == table, "table").otherwise("list")
    return F.when((listed + table + junk) > prose, named)


def statistics(documents: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """One row per document: counts, ratios (null where there is nothing to divide by), and kind."""
    c = counts(documents, chunk)

    def ratio(a: str, b: str) -> Column:
        return F.round(F.try_divide(F.col(a), F.col(b)), 6)

    return c.select(
        "doc_id",
        F.col("chars").alias("visible_chars"),
        F.col("words").alias("word_count"),
        ratio("word_chars", "words").alias("mean_word_length"),
        ratio("symbols", "chars").alias("symbol_ratio"),
        ratio("digits", "chars").alias("digit_ratio"),
        F.col("lines").alias("line_count"),
        ratio("ended", "lines").alias("ended_line_share"),
        ratio("common", "words").alias("common_word_share"),
        *[ratio(p, "chars").alias(f"{p}_share") for p in ("prose", "list", "table", "junk")],
        kind(F.col("prose"), F.col("list"), F.col("table"), F.col("junk")).alias("kind"),
    )


def not_prose(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind)`` of the documents that are mostly not prose."""
    return statistics(documents).where(F.col("kind").isNotNull()).select("doc_id", "kind")
