"""Sample matching target category proportions (problem 5).

Categories are counted, integer quotas are allocated by largest remainder above minimum floors and
below what is available, and of each category the rows with the smallest random keys are drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize, small_enough
from .splits import spelling_key

CATEGORY = ("task_type", "source_dataset", "tier")


def pool(samples: DataFrame, annotations: DataFrame, targets: DataFrame) -> DataFrame:
    """``(sample_id, task_type, source_dataset, tier)`` of every sample that can be drawn.

    Of several deliveries of a sample the last one with the value counts, of several annotations the
    last; only tiers 1, 2 and 3 count.  Spellings that agree but for case, spaces and hyphens are one
    category, spelled as in ``targets`` where it occurs there.
    """
    def latest(value: str) -> Column:
        usable = F.trim(F.col(value)) != ""
        return F.max(F.when(usable, F.struct(F.col("ingested_at"), spelling_key(F.col(value)).alias("v"))))["v"].alias(f"__{value}")

    named = samples.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(latest("task_type"), latest("source_dataset"))
    named = named.where("__task_type is not null and __source_dataset is not null")
    graded = annotations.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.max(F.struct("annotated_at", "tier"))["tier"].alias("tier"))
    graded = graded.where(F.col("tier").isin(1, 2, 3))
    rows = named.join(graded, "sample_id")
    for value in ("task_type", "source_dataset"):
        # One row per spelling in the targets table, which is a table of parameters.
        spelled = targets.where(F.col(value).isNotNull()).groupBy(spelling_key(F.col(value)).alias(f"__{value}")).agg(F.min(value).alias(value))
        rows = rows.join(spelled, f"__{value}", "left").withColumn(value, F.coalesce(value, f"__{value}"))
    return rows.select("sample_id", *CATEGORY)


def needs(members: DataFrame, targets: DataFrame, draw: int) -> DataFrame:
    """Of every target: ``need`` (the larger of its rounded-up share and its floor) and ``available``."""
    counts = members.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("available"))
    share = F.ceil(F.col("target_bp").cast("long") * F.lit(draw) / F.lit(10_000))
    need = F.greatest(share, F.col("min_rows").cast("long"))
    wanted = targets.select(*CATEGORY, "target_bp", "min_rows")
    return wanted.join(counts, list(CATEGORY), "left").select(*CATEGORY, "target_bp", "min_rows", need.alias("need"), F.coalesce("available", F.lit(0)).alias("available"))


def largest_remainder(exact: list[float], most: list[int], size: int) -> list[int]:
    """Integers near ``exact`` that sum to ``size`` if ``most`` lets them; the largest remainders are raised first."""
    out = [min(int(x), m) for x, m in zip(exact, most, strict=True)]
    spare = size - sum(int(x) for x in exact)
    for k in sorted(range(len(out)), key=lambda k: (int(exact[k]) - exact[k], k)):
        if spare > 0 and out[k] < most[k]:
            out[k] += 1
            spare -= 1
    return out


def quotas(demand: DataFrame, draw: int, most: int = 1_000_000) -> DataFrame:
    """``demand`` with the integer ``quota`` of each category; all quotas sum to ``draw`` or less.

    Each gets its floor, capped by what is available; the rest of the draw is spread in proportion
    to the targets' unmet shares by largest remainder, again and again while caps turn rows back.
    Floors that together exceed the draw are scaled down to it, again by largest remainder.  Ties go
    by category name.  The table of categories is one of parameters and is checked to have at most
    ``most`` rows.
    """
    if not small_enough(demand, most):
        raise ValueError(f"more than {most} target categories")
    rows = sorted((r.asDict() for r in demand.collect()), key=lambda r: tuple(str(r[c]) for c in CATEGORY))
    floors = [min(r["available"], r["min_rows"] or 0) for r in rows]
    if sum(floors) > draw:
        floors = largest_remainder([f * draw / sum(floors) for f in floors], floors, draw)
    for r, floor in zip(rows, floors, strict=True):
        r["quota"] = floor
    while (left := draw - sum(r["quota"] for r in rows)) > 0:
        open_ = [r for r in rows if r["quota"] < r["available"] and (r["target_bp"] or 0) > 0]
        if not open_:
            break
        want = [max(0.0, r["target_bp"] * draw / 10_000 - r["quota"]) for r in open_]
        if not sum(want):
            want = [float(r["target_bp"]) for r in open_]
        give = largest_remainder([left * w / sum(want) for w in want], [r["available"] - r["quota"] for r in open_], left)
        if not sum(give):
            break
        for r, g in zip(open_, give, strict=True):
            r["quota"] += g
    schema = demand.schema.add("quota", "long")
    return demand.sparkSession.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)


def random_key(identity: Column, seed: int) -> Column:
    """A reproducible key, uniform on 60 bits, the same in any engine that has MD5."""
    digest = F.md5(F.concat(identity, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def smallest_keys(rows: DataFrame, category: list[str], quota: DataFrame, identity: str, seed: int = 42, cell_rows: int = 1000) -> DataFrame:
    """Of each category the ``quota`` rows with the smallest random keys, ties by ``identity``.

    The keys are uniform, so each category is cut into cells of about ``cell_rows`` rows; counts per
    cell tell in which the quota is reached.  Rows below that cell are taken and rows above it are
    not, where they are read; only the rows of the one cell are ranked.  ``quota`` has one row per
    category, as checked by :func:`quotas`; ``rows`` are read three times and never shuffled whole.
    """
    wanted = rows.join(F.broadcast(quota.where("quota > 0").select(*category)), category, "left_semi")
    sizes = wanted.groupBy(*category).agg(F.count(F.lit(1)).alias("__all"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("__all") / F.lit(cell_rows))).cast("long")
    widths = materialize(quota.where("quota > 0").join(sizes, category).select(*category, "quota", F.ceil(F.lit(1 << 60) / cells).cast("long").alias("__width")), "widths")
    keyed = rows.withColumn("__key", random_key(F.col(identity), seed))
    counts = keyed.join(F.broadcast(widths), category).groupBy(*category, "quota", F.expr("__key div __width").alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*category).orderBy("__cell")
    reached = counts.withColumn("__sum", F.sum("__n").over(upto)).where("__sum - __n < quota")
    last = reached.groupBy(*category).agg(F.max(F.struct("__cell", (F.col("quota") - (F.col("__sum") - F.col("__n"))).alias("__take"))).alias("__last"))
    last = materialize(last.join(widths.select(*category, "__width"), category).select(*category, "__width", "__last.*"), "cuts")
    placed = keyed.join(F.broadcast(last), category).withColumn("__at", F.expr("__key div __width"))
    edge = placed.where("__at = __cell").withColumn("__rank", F.row_number().over(Window.partitionBy(*category).orderBy("__key", identity))).where("__rank <= __take")
    return placed.where("__at < __cell").select(*rows.columns).unionByName(edge.select(*rows.columns))


def draw_sample(samples: DataFrame, annotations: DataFrame, targets: DataFrame, share: int = 5, seed: int = 42) -> DataFrame:
    """The draw itself: ``sample_id`` and category of ``floor(pool / share)`` rows or fewer."""
    members = materialize(pool(samples, annotations, targets), "pool")
    draw = members.count() // share
    return smallest_keys(members, list(CATEGORY), quotas(needs(members, targets, draw), draw), "sample_id", seed)


def report(samples: DataFrame, annotations: DataFrame, targets: DataFrame, share: int = 5) -> DataFrame:
    """Every target category: what it needs, what is available, its quota, and what is in its way.

    ``short_by`` is how far the quota lies below the need; ``reason`` is ``available`` where the pool
    has too few rows, ``draw`` where the floors or shares of others leave too few, else null.
    """
    members = materialize(pool(samples, annotations, targets), "pool")
    draw = members.count() // share
    dealt = quotas(needs(members, targets, draw), draw)
    short = F.greatest(F.lit(0), F.col("need") - F.col("quota")).cast("long")
    reason = F.when(F.col("available") < F.col("need"), "available").when(short > 0, "draw")
    return dealt.select(*CATEGORY, "target_bp", "min_rows", "need", "available", "quota", short.alias("short_by"), reason.alias("reason"))


def shortfalls(samples: DataFrame, annotations: DataFrame, targets: DataFrame, share: int = 5) -> DataFrame:
    """Every target category with fewer pool samples than it needs, with its quota."""
    return report(samples, annotations, targets, share).where("reason = 'available'")
