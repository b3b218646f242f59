"""Result tables: last deliveries, merges, resumption, signals and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order``; ties by the other values.  One aggregate, no sort of rows."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    packed = F.max(F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])).alias("__r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the least by ``order``; ties by the other values."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    packed = F.min(F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])).alias("__r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def merge_last(older: DataFrame, newer: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Two result tables as one: per key the last row of the newer table, else of the older."""
    both = older.withColumn("__file", F.lit(0)).unionByName(newer.withColumn("__file", F.lit(1)))
    return last_by(both, keys, ["__file", *order]).drop("__file")


def pending(samples: DataFrame, configs: DataFrame, done: DataFrame, sample: str = "sample_id", config: str = "config_id") -> DataFrame:
    """The work list: each sample with each configuration, without the pairs done.

    The configurations are a small table of parameters, exploded from an array rather than joined.
    """
    listed = configs.agg(F.array_sort(F.collect_set(config)).alias("__all"))
    work = samples.select(sample).distinct().join(F.broadcast(listed)).select(sample, F.explode("__all").alias(config))
    return work.join(done.select(sample, config).distinct(), [sample, config], "left_anti")


def first_signal(tables: Sequence[tuple[str, DataFrame, str]], keys: Sequence[str], default: Column) -> DataFrame:
    """Per key of any table: the value of the first table that has one, and that table's name.

    Tables come as (name, table, value column) in order of precedence; one union and one aggregate
    stand for the full outer joins.  A null value is no signal; keys without one get the default.
    """
    parts = [t.select(*keys, F.lit(i).alias("__i"), F.lit(name).alias("__name"), F.col(value).alias("__value")) for i, (name, t, value) in enumerate(tables)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    found = F.min(F.when(F.col("__value").isNotNull(), F.struct("__i", "__value", "__name"))).alias("__first")
    out = both.groupBy(*keys).agg(found)
    return out.select(*keys, F.coalesce("__first.__value", default).alias("value"), F.coalesce("__first.__name", F.lit("default")).alias("signal"))


def with_defaults(rows: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """``rows`` with columns of ``lookup``, missing ones replaced by defaults."""
    found = rows.join(lookup.select(key, *defaults), key, "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Two tables of one row per key: the top one's values win, the base fills its nulls."""
    names = [c for c in base.columns if c != key]
    return base.alias("b").join(top.alias("t"), key, "inner").select(key, *[F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c) if c in top.columns else F.col(f"b.{c}") for c in names])


def priority_dedup(df: DataFrame, keys: Sequence[Column], priority: Column, order: Sequence[str], identity: str) -> DataFrame:
    """The winner of every duplicate group and how many rows it stands for.

    Rows are duplicates when all keys agree; the highest priority wins, then the first by order.
    """
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, F.struct((-priority).alias("__p"), *[F.col(c) for c in order], F.col(identity).alias("__id")).alias("__r"))
    won = rows.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__r").alias("__r"), F.count(F.lit(1)).alias("n_rows"))
    return won.select(F.col("__r.__id").alias(identity), "n_rows")


def duplicate_counts(df: DataFrame, keys: Sequence[Column], priority: Column, order: Sequence[str], label: str) -> DataFrame:
    """How many rows labelled ``loser`` lost to a winner labelled ``winner``."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*named, F.struct((-priority).alias("__p"), *[F.col(c) for c in order]).alias("__r"), F.coalesce(F.col(label), F.lit("")).alias("__label"))
    won = rows.groupBy(*names).agg(F.min_by("__label", "__r").alias("winner"))
    counted = rows.groupBy(*names, F.col("__label").alias("loser")).agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.join(won, names).select("winner", "loser", (F.col("n") - (F.col("winner") == F.col("loser")).cast("long")).alias("n"))
    return pairs.groupBy("winner", "loser").agg(F.sum("n").alias("n")).where("n > 0")


def image_key(path: Column, phash: Column | None = None, md5: Column | None = None) -> Column:
    """What tells images apart: a perceptual hash, else the MD5 of the bytes, else that of the path; null without a path."""
    known = path.isNotNull() & (F.trim(path) != "")
    hashes = [h for h in (phash, md5) if h is not None]
    return F.when(known, F.coalesce(*hashes, F.md5(F.lower(F.trim(path)))))


def two_signal_dedup(df: DataFrame, text: Column, image: Column, priority: Column, identity: str) -> DataFrame:
    """The winner of every group of samples with the same text and the same image, and how many rows it stands for.

    The same text over another image is no duplicate, nor is the same image with another text.  A
    sample without an image cannot be told from the others of its text and counts with those of the
    least image key there.  The highest priority wins, then the smaller id.  ``image`` may be the
    class of near-equal fingerprints.
    """
    rows = df.select(text.alias("__t"), image.alias("__i"), F.struct((-priority).alias("p"), F.col(identity).alias("id")).alias("__r"))
    exact = rows.groupBy("__t", "__i").agg(F.min("__r").alias("__r"), F.count(F.lit(1)).alias("__n"))
    # The images of a text were counted: their least is one aggregate over distinct pairs.
    least = exact.groupBy("__t").agg(F.min("__i").alias("__least"))
    named = exact.where("__i is null").join(least, "__t").select("__t", F.col("__least").alias("__i"), "__r", "__n")
    won = exact.where("__i is not null").unionByName(named).groupBy("__t", "__i").agg(F.min("__r").alias("__r"), F.sum("__n").alias("n_rows"))
    return won.select(F.col("__r.id").alias(identity), "n_rows")


def check_claims(figures: DataFrame, claims: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Claims about named figures: name, kind, expected, tolerance, what was found, and whether it holds.

    A kind is ``near`` (within the tolerance), ``least`` or ``most``; a figure that is missing or null fails.
    """
    said = figures.sparkSession.createDataFrame(list(claims), "name string, kind string, expected double, tolerance double")
    found = figures.groupBy("name").agg(F.max("value").alias("value"))
    off = F.col("value") - F.col("expected")
    holds = F.when(F.col("kind") == "near", F.abs(off) <= F.col("tolerance")).when(F.col("kind") == "least", off >= -F.col("tolerance")).when(F.col("kind") == "most", off <= F.col("tolerance"))
    return F.broadcast(said).join(found, "name", "left").select("name", "kind", "expected", "tolerance", "value", F.coalesce(holds, F.lit(False)).alias("holds"))
