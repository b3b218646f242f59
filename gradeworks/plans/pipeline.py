"""A pipeline of stages that are written, skipped when done, and forced on demand."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, text, vectors
from ..operators import results, routing, sampling, similarity, studies
from ..sources.records import stage_done
from ..workspace import materialize


@dataclass(frozen=True)
class Stage:
    """A name, the stages it reads, and a function from their tables to its own."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]


def run(spark: SparkSession, stages: Sequence[Stage], folder: str, inputs: dict[str, DataFrame], force: Sequence[str] = (), start: str | None = None) -> dict[str, str]:
    """Run stages in order; what each did: ``done`` before, ``made`` now.

    A stage whose output is complete is skipped unless it is forced or lies at or after ``start``.
    """
    tables, did, again = dict(inputs), {}, False
    for stage in stages:
        again = again or stage.name == start
        path = f"{folder}/{stage.name}"
        if stage_done(spark, path) and stage.name not in force and not again:
            did[stage.name] = "done"
        else:
            stage.make(*[tables[n] for n in stage.needs]).write.mode("overwrite").parquet(path)
            did[stage.name] = "made"
        tables[stage.name] = spark.read.parquet(path)
    return did


def deduplicated(samples: DataFrame) -> DataFrame:
    """The winner of every group of samples with the same query and answer."""
    own = results.priority_dedup(samples, [text.text_key(F.col("query")), text.query_form(F.col("gt_answer"))], F.lit(0), ["sample_id"], "sample_id")
    return samples.join(own.select("sample_id"), "sample_id", "left_semi")


def scored(samples: DataFrame) -> DataFrame:
    """Samples with prior scores, composite, tier and its chances."""
    raw = samples.withColumns({"v": features.visual_score(), "r": features.reasoning_score(), "s": features.extent_score()})
    tier = features.tier_of(features.composite(F.col("v"), F.col("r"), F.col("s")))
    vds, rds, ses, out = features.source_rules(F.col("v"), F.col("r"), F.col("s"), tier, F.col("source_dataset"), F.col("query"))
    made = raw.select(*samples.columns, vds.alias("vds_est"), rds.alias("rds_est"), ses.alias("ses_est"), out.alias("tier_prior"))
    made = made.withColumn("composite_est", features.composite(F.col("vds_est"), F.col("rds_est"), F.col("ses_est")))
    return made.withColumn("tier_prior_soft", features.soft_tiers(F.col("tier_prior"), F.col("composite_est")))


def sampling_stages(per_source: int = 200, size: int = 1000) -> list[Stage]:
    """Deduplicate, score, bound each source, and draw in proportion to the tiers."""
    return [
        Stage("deduplicated", ("samples",), deduplicated),
        Stage("scored", ("deduplicated",), scored),
        Stage("candidates", ("scored",), lambda s: sampling.per_group(s, "source_dataset", per_source, "sample_id")),
        Stage("selected", ("candidates",), lambda c: sampling.proportional(c, "tier_prior", size, [sampling.hash_order("sample_id"), "sample_id"])),
    ]


def selected_anchors(samples: DataFrame, size: int, minima: Sequence[tuple[str, int]], seed: int = 42) -> DataFrame:
    """Anchors: rows that meet the minima first, then representatives of all embeddings under a kernel as wide as their median distance.

    ``samples`` has sample_id, task, tier, source_dataset, vds, rds, ses, has_table and has_chart; the
    result is ``sample_id, why`` (``minimum`` or ``representative``), at most ``size`` rows unless the
    minima ask for more.
    """
    embedded = materialize(samples.withColumn("embedding", vectors.sample_embedding(F.col("task"), F.col("tier"), F.col("source_dataset"), [F.col(c) for c in ("vds", "rds", "ses")], F.col("has_table"), F.col("has_chart"))), "embedded")
    sigma = similarity.kernel_width(embedded, "sample_id", "embedding", seed=seed).first()["sigma"]
    seeded = studies.constrained(embedded.select("sample_id", *dict.fromkeys(c for c, _ in minima)), minima, "sample_id", seed).select("sample_id", F.lit("minimum").alias("why"))
    seeded = materialize(seeded, "seeded")
    left = size - seeded.count()
    if left <= 0:
        return seeded
    free = embedded.join(seeded, "sample_id", "left_anti")
    # An embedding is told by one of its samples; equal ones weigh together.
    picked = sampling.facility_location(free, "embedding", "sample_id", left, max(float(sigma or 1.0), 1e-6))
    return seeded.unionByName(picked.select("sample_id", F.lit("representative").alias("why")))


def selection_stages(size: int = 1500, validation: int = 750, minima: Sequence[tuple[str, int]] = (("task", 20), ("tier", 40), ("source_dataset", 5))) -> list[Stage]:
    """Choose anchors, draw validation samples by tier weights from the rest, and report on both."""
    def drawn(samples: DataFrame, anchors: DataFrame) -> DataFrame:
        rest = samples.join(anchors, "sample_id", "left_anti").where("tier in (1, 2, 3)")
        return sampling.weighted_tiers(rest.select("sample_id", "tier"), "tier", validation, {1: 0.20, 2: 0.55, 3: 0.25}, "sample_id")

    def report(samples: DataFrame, anchors: DataFrame, chosen: DataFrame) -> DataFrame:
        both = anchors.select("sample_id", F.lit("anchor").alias("split")).unionByName(chosen.select("sample_id", F.lit("validation").alias("split")))
        return both.join(samples.select("sample_id", "task", "tier"), "sample_id").groupBy("split", "task", "tier").agg(F.count(F.lit(1)).alias("n"))

    return [
        Stage("anchors", ("samples",), lambda s: selected_anchors(s, size, minima)),
        Stage("validation", ("samples", "anchors"), drawn),
        Stage("selection_report", ("samples", "anchors", "validation"), report),
    ]


def cascade_stages() -> list[Stage]:
    """Evaluate the anchors in full, cascade over the rest, merge the labels and check them.

    Reads ``matrix`` and ``splits`` (sample_id, split).  The cascade tries a tier only on samples
    that no lower tier solved, so its calls are what is paid for.
    """
    def anchors(matrix: DataFrame, splits: DataFrame) -> DataFrame:
        return routing.cheapest(matrix.join(splits.where("split = 'anchor'").select("sample_id"), "sample_id", "left_semi"), ["tier", "cost"])

    def rest(matrix: DataFrame, splits: DataFrame) -> DataFrame:
        return routing.cascade(matrix.join(splits.where("split = 'anchor'").select("sample_id"), "sample_id", "left_anti"))

    def merged(full: DataFrame, cascaded: DataFrame) -> DataFrame:
        one = full.select("sample_id", "config_id", F.col("n_configs").alias("calls"), F.lit("anchor").alias("origin"))
        return one.unionByName(cascaded.select("sample_id", "config_id", "calls", F.lit("cascade").alias("origin")))

    def validated(matrix: DataFrame, labels: DataFrame) -> DataFrame:
        whole = matrix.agg(F.count(F.lit(1)).alias("all_calls"))
        sums = labels.agg(F.count(F.lit(1)).alias("samples"), F.count("config_id").alias("routable"), F.sum("calls").alias("calls"))
        rate = routing.violation_rate(matrix).select(F.col("rate").alias("violation_rate"))
        saved = F.round(1 - F.try_divide(F.col("calls"), F.col("all_calls")), 6).alias("calls_saved")
        return sums.join(F.broadcast(whole)).join(F.broadcast(rate)).select("samples", "routable", "calls", saved, "violation_rate")

    return [
        Stage("anchor_labels", ("matrix", "splits"), anchors),
        Stage("cascade_labels", ("matrix", "splits"), rest),
        Stage("labels", ("anchor_labels", "cascade_labels"), merged),
        Stage("validated", ("matrix", "labels"), validated),
    ]
