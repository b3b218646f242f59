"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..workspace import materialize
from . import consensus, leakage, mixture, packing, pairs, quality, quantiles, splits, top_n

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.contested(table(spark, d, "judge_scores"))


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "judge_scores"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.published_agreement(table(spark, d, "judge_scores"), table(spark, d, "complexity_annotations"))


def p1_convergence(spark: SparkSession, d: str) -> DataFrame:
    return consensus.convergence(table(spark, d, "judge_scores")).select("converged")


def p2_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact at any size: the summaries tell which rows to count once more, where they have a rank error."""
    rows, keys, metrics = materialize(quantiles.run_measures(table(spark, d, "eval_results")), "measures"), ["config_id", "day"], ["latency_ms", "total_cost_usd"]
    return quantiles.exact_quantiles(rows, quantiles.summaries(rows, keys, metrics), keys, metrics)


def p2_config_percentiles(spark: SparkSession, d: str) -> DataFrame:
    daily = materialize(quantiles.daily_summaries(table(spark, d, "eval_results")), "daily")
    return quantiles.read_quantiles(quantiles.roll_up(daily, ["config_id"]), ["config_id"])


def p2_rank_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per configuration and metric, whether every percentile lies within its stated rank error."""
    rows = materialize(quantiles.run_measures(table(spark, d, "eval_results")), "measures")
    read = quantiles.read_quantiles(quantiles.summaries(rows, ["config_id"], ["latency_ms", "total_cost_usd"], k=256), ["config_id"], k=256)
    return quantiles.within_bounds(rows, materialize(read, "percentiles"), ["config_id"], ["latency_ms", "total_cost_usd"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_samples(table(spark, d, "bench_samples"), table(spark, d, "image_collections"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "bench_samples")
    return splits.stratified_splits(samples, splits.sample_groups(samples, table(spark, d, "image_collections")))


def p3_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every split: all samples once, no group in two, every label's share near its target."""
    splits_ = materialize(p3_splits(spark, d), "splits")
    samples = table(spark, d, "bench_samples").where("sample_id is not null")
    labels = samples.groupBy("sample_id").agg(F.coalesce(F.min(F.upper(F.trim("task_type"))), F.lit("")).alias("label"))
    groups = splits_.groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"))
    shares = splits_.join(labels, "sample_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    # A share can miss its target by what whole groups do not divide into.
    slack = F.greatest(F.lit(0.05) * F.col("n"), F.lit(3))
    near = ((F.abs(F.col("train") - 0.8 * F.col("n")) <= slack) & (F.abs(F.col("validation") - 0.1 * F.col("n")) <= slack) & (F.abs(F.col("test") - 0.1 * F.col("n")) <= slack))
    whole = groups.agg(F.bool_and(F.col("k") == 1).alias("groups_whole"), F.sum("n").alias("samples"))
    return whole.crossJoin(shares.agg(F.bool_and(near).alias("labels_near")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.cheapest_correct_runs(table(spark, d, "eval_results"))


def p4_skipping(spark: SparkSession, d: str) -> DataFrame:
    """Row groups that the top N reads and skips, summed over files."""
    files = top_n.skipped_row_groups(table(spark, d, "eval_results"))
    return files.agg(F.sum("row_groups_read").alias("row_groups_read"), F.sum("row_groups_skipped").alias("row_groups_skipped"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "bench_samples"), table(spark, d, "complexity_annotations"), table(spark, d, "mix_targets")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shortfalls(*_mixture(spark, d)).select(*mixture.CATEGORY)


def p5_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_sample(*_mixture(spark, d))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every draw: sizes within the draw, the quotas and the pool, floors kept, no row twice."""
    samples, notes, targets = _mixture(spark, d)
    told = materialize(mixture.report(samples, notes, targets), "report")
    drawn = materialize(mixture.draw_sample(samples, notes, targets), "drawn")
    sizes = drawn.groupBy(*mixture.CATEGORY).agg(F.count(F.lit(1)).alias("n"))
    both = told.join(sizes, list(mixture.CATEGORY), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = mixture.pool(samples, notes, targets).count() // 5
    whole = both.agg((F.sum("n") <= size).alias("within_draw"), F.bool_and(F.col("n") == F.col("quota")).alias("quotas_met"), (F.bool_and(F.col("n") >= F.least("available", "min_rows")) | (F.sum(F.least("available", "min_rows")) > size)).alias("floors_kept"))
    return whole.crossJoin(drawn.agg((F.count_distinct("sample_id") == F.count(F.lit(1))).alias("no_row_twice")))


def p5_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shortfalls(*_mixture(spark, d)).select(*mixture.CATEGORY, "need", "available")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "bench_samples"), table(spark, d, "eval_results"), table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(packing.pack(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(table(spark, d, "documents")))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing: all tokens and pieces placed, none beyond a container, few containers half empty."""
    held = packing.containers(packing.pack(table(spark, d, "documents")))
    return held.agg(F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), (F.min("unused") >= 0).alias("within_capacity"), (F.count(F.lit(1)) <= F.ceil(F.sum("tokens") / 4096 * 1.05) + 1).alias("packed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.clean(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every document that are not blank, as the chunked counts add them up."""
    return quality.counts(table(spark, d, "documents"), 1 << 13).select("doc_id", F.col("lines").alias("line_count"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        *(p1_found, p1_reliability, p1_agreement, p1_convergence, p2_daily_percentiles, p2_config_percentiles, p2_rank_bounds),
        *(p3_found, p3_splits, p3_split_checks, p4_found, p4_skipping, p5_found, p5_draw, p5_checks, p5_shortfalls, p6_found, p7_found, p7_containers, p7_checks),
        *(p8_found, p8_cleaned, p9_found, p9_statistics, p9_lines),
    )
}
