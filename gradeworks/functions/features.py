"""Features of samples and configurations: difficulty scores, tiers, vectors and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_name, has_any, word_count

#: Words in a query that tell of places, calculation, several documents and wide spans.
PLACES = ("where", "position", "location", "top", "bottom", "left", "right", "corner", "region", "area", "locate", "coordinates", "bbox", "bounding box")
CALCULATION = ("compare", "calculate", "sum", "average", "difference", "ratio", "trend", "total", "how many", "increase", "decrease", "percent", "highest", "lowest", "smallest", "largest", "minimum", "maximum", "greater than", "less than", "more than")
SEVERAL = ("based on", "according to both", "considering", "cross-reference", "across pages", "between page", "which page", "what page", "page number")
SPANS = ("across", "throughout", "span", "spread", "entire", "whole document", "multiple sections", "each section")
#: Weights of the three scores, bounds of the tiers, and the chances a tier starts from.
WEIGHTS = (0.30, 0.45, 0.25)
BOUNDS = (2.2, 3.0)
BASE = {1: (0.70, 0.25, 0.05), 2: (0.15, 0.65, 0.20), 3: (0.05, 0.25, 0.70)}
TASKS = ("T1", "T2", "T3", "T4", "T5", "T6")


def flag(name: str) -> Column:
    """A boolean column, null counting as false."""
    return F.coalesce(F.col(name), F.lit(False))


def visual_score() -> Column:
    """4 with chart and figure, 3 with one of them, 2 where the query tells of places, else 1."""
    chart, figure = flag("has_chart"), flag("has_figure")
    return F.when(chart & figure, 4).when(chart | figure, 3).when(has_any(F.col("query"), PLACES), 2).otherwise(1)


def reasoning_score() -> Column:
    """4 over several documents, 3 for calculation, 1 for fewer than 8 words, else 2."""
    q = F.col("query")
    return F.when(has_any(q, SEVERAL), 4).when(has_any(q, CALCULATION), 3).when(word_count(q) < 8, 1).otherwise(2)


def extent_score() -> Column:
    """4 for several pages, 3 with table and figure or a wide span, 2 with one, else 1."""
    table, figure = flag("has_table"), flag("has_figure")
    return F.when(F.coalesce("num_pages", F.lit(1)) > 1, 4).when((table & figure) | has_any(F.col("query"), SPANS), 3).when(table | figure, 2).otherwise(1)


def composite(v: Column, r: Column, s: Column) -> Column:
    """Weighted sum of the three scores, 4 places."""
    return F.round(WEIGHTS[0] * v + WEIGHTS[1] * r + WEIGHTS[2] * s, 4)


def tier_of(score: Column) -> Column:
    """1 below 2.2, 2 below 3.0, else 3."""
    return F.when(score < BOUNDS[0], 1).when(score < BOUNDS[1], 2).otherwise(3)


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` kept between two bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def soft_tiers(tier: Column, score: Column) -> Column:
    """Chances of the three tiers: those the tier starts from, moved by the distance to its bounds.

    Rounded to 4 places; what rounding leaves goes to the largest.
    """
    low, high = BOUNDS

    def outer(own: float, near: float, far: float, distance: Column) -> tuple[Column, Column, Column]:
        top = clamp(F.lit(own) + clamp(distance * 0.10, -0.10, 0.10), 0.50, 0.95)
        return top, F.round((1.0 - top) * (near / (near + far)), 4), F.round((1.0 - top) * (far / (near + far)), 4)

    one = outer(BASE[1][0], BASE[1][1], BASE[1][2], F.lit(low) - score)
    three = outer(BASE[3][2], BASE[3][1], BASE[3][0], score - F.lit(high))
    to_low = F.when(score - low < 0.5, F.least(F.lit(0.10), (0.5 - (score - low)) * 0.20)).otherwise(0.0)
    to_high = F.when(high - score < 0.5, F.least(F.lit(0.10), (0.5 - (high - score)) * 0.20)).otherwise(0.0)
    first = F.when(to_low > 0, F.least(F.lit(0.40), BASE[2][0] + to_low)).otherwise(BASE[2][0])
    last = F.when(to_high > 0, F.least(F.lit(0.40), BASE[2][2] + to_high)).otherwise(BASE[2][2])
    once = F.when(to_low > 0, F.greatest(F.lit(0.40), BASE[2][1] - to_low)).otherwise(BASE[2][1])
    middle = F.when(to_high > 0, F.greatest(F.lit(0.40), once - to_high)).otherwise(once)
    raw = [F.when(tier == 1, one[i]).when(tier == 2, (first, middle, last)[i]).otherwise((three[2], three[1], three[0])[i]) for i in range(3)]
    total = raw[0] + raw[1] + raw[2]
    parts = [F.round(x / total, 4) for x in raw]
    rest = F.round(1.0 - (parts[0] + parts[1] + parts[2]), 4)
    top = F.greatest(*parts)
    lead = [parts[0] == top, (parts[1] == top) & (parts[0] != top), (parts[2] == top) & (parts[0] != top) & (parts[1] != top)]
    return F.array(*[F.round(p + F.when(is_top, rest).otherwise(0.0), 4) for p, is_top in zip(parts, lead, strict=True)])


def source_rules(v: Column, r: Column, s: Column, tier: Column, source: Column, query: Column) -> tuple[Column, Column, Column, Column]:
    """Scores and tier after the bounds that a source sets."""
    name = canonical_name(F.coalesce(source, F.lit("")))
    counts = has_any(query, CALCULATION)
    rds = F.when(name == "tabfact", F.greatest(r, F.lit(2))).when(name.isin("wtq", "wikitablequestions"), F.greatest(r, F.lit(3))).otherwise(r)
    ses = F.when(name == "mpdocvqa", F.lit(4)).otherwise(s)
    out = (
        F.when(name == "rvlcdip", F.lit(1))
        .when(name == "mpdocvqa", F.greatest(tier, F.lit(2)))
        .when((name == "slidevqa") & counts, F.greatest(tier, F.lit(2)))
        .when(name.isin("slidevqa", "cord", "sroie"), F.least(tier, F.lit(2)))
        .otherwise(tier)
    )
    return v, rds, ses, out


def one_hot(value: Column, categories: Sequence[str]) -> Column:
    """1 where a category equals the value; all 0 for others and null."""
    return F.transform(F.array(*map(F.lit, categories)), lambda c: F.coalesce((c == value).cast("double"), F.lit(0.0)))


def outer_product(a: Column, b: Column) -> Column:
    """All products of two vectors, the first one's order leading."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """The squared Euclidean distance of two vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def tuple_distance(a: Column, b: Column) -> Column:
    """Positions in which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def region(cx: Column, cy: Column) -> Column:
    """Where a point lies on a page: top, bottom, left, right or centre."""
    return F.when(cy < 0.33, "top").when(cy > 0.67, "bottom").when(cx < 0.4, "left").when(cx > 0.6, "right").otherwise("center")


def token_cost(rates: Sequence[Column], tokens: Sequence[Column]) -> Column:
    """Tokens per million times their rates, missing ones 0, 8 places."""
    parts = [F.coalesce(t, F.lit(0)) / 1e6 * F.coalesce(r, F.lit(0.0)) for r, t in zip(rates, tokens, strict=True)]
    return F.round(sum(parts[1:], parts[0]), 8)
