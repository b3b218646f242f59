"""Consensus from several annotators' labels (problem 1).

A community confusion model.  Every item has a hidden score; every annotator, on every axis, has a
confusion matrix; annotators belong to a few types that share confusion matrices.  Variational
updates alternate between the items' scores, the types' matrices, the annotators' types and their
own matrices, whose prior is that of their type: an annotator with few labels is judged like its
type, one with many by its own record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import forget, materialize, small_enough
from .dedupe import last_delivery

AXES = ("vds", "rds", "ses")
SCORES = 4
#: Prior pseudo-counts of the five types: sound, fair, random, too high, too low.
SHAPES = ((0.85, 0), (0.55, 0), (0.25, 0), (0.6, 1), (0.6, -1))


@dataclass(frozen=True)
class Fit:
    """The fitted model: ``ratings`` with their items' posteriors, the annotators' table, and how the fit ended."""

    ratings: DataFrame
    annotators: DataFrame
    log_prior: dict[str, list[float]]
    rounds: int
    moved: float
    converged: bool


def final_ratings(judge_scores: DataFrame) -> DataFrame:
    """``(sample_id, axis, judge_id, score)`` of each judge's last rating of a sample.

    The last row is that with the greatest rated_at, then ingested_at, then scores.  Null scores
    and scores outside 1..4 are no ratings; rows without a sample or a judge are left out.
    """
    known = judge_scores.where(F.col("sample_id").isNotNull() & F.col("judge_id").isNotNull())
    last = last_delivery(known, ["sample_id", "judge_id"], ["rated_at", "ingested_at"], ["sample_id", "judge_id", *AXES])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("score")) for a in AXES]))
    long = last.select("sample_id", "judge_id", pairs.alias("r")).select("sample_id", "r.axis", "judge_id", "r.score")
    return long.where(F.col("score").between(1, SCORES))


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function for positive arguments, by recurrence and its asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        shift = np.where(low, shift - 1 / np.where(low, x, 1), shift)
        x = np.where(low, x + 1, x)
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def type_priors() -> np.ndarray:
    """(types, scores, scores) pseudo-counts from which the types start."""
    out = []
    for share, lean in SHAPES:
        m = np.full((SCORES, SCORES), (1 - share) / (SCORES - 1))
        for t in range(SCORES):
            to = min(max(t + lean, 0), SCORES - 1)
            m[t] = (1 - share) / (SCORES - 1)
            m[t, to] = share
        out.append(10 * m)
    return np.array(out)


def type_shares(counts: np.ndarray, types: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each annotator's posterior over types, given its expected counts (n, scores, scores)."""
    logs = digamma(types) - digamma(types.sum(axis=2, keepdims=True))
    score = np.einsum("nts,mts->nm", counts, logs) + np.log(weight)
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def own_confusion(counts: np.ndarray, shares: np.ndarray, types: np.ndarray, strength: float) -> np.ndarray:
    """Dirichlet parameters of each annotator's own matrix: its type's mean, plus its counts."""
    mean = types / types.sum(axis=2, keepdims=True)
    return strength * np.einsum("nm,mts->nts", shares, mean) + counts


#: One row per axis and judge: the logarithm ``l`` of its matrix and its expected counts ``n`` (4 x 4, true score
#: first), its chances ``k`` of each type, and how far its matrix moved in the last round.
ANNOTATORS = "axis string, judge_id string, l array<double>, n array<double>, k array<double>, moved double"
CELLS = [f"{t}{s}" for t in range(SCORES) for s in range(SCORES)]
KEYS = ["axis", "judge_id"]


def _posterior(ratings: DataFrame, annotators: DataFrame, log_prior: dict[str, list[float]], few: bool, total: int) -> DataFrame:
    """``ratings`` with the posterior ``q0..q3`` of their item.

    The ratings lie partitioned and sorted by item.  With few annotators their table is broadcast,
    and a round is one pass without a shuffle; else ratings meet it by judge, where judges with more
    than a thousandth of all ratings, fewer than 1,000 for each axis, are broadcast all the same.
    """
    # The priors travel with the table: the code over the ratings stays the same from round to round.
    prior = "case axis " + " ".join(f"when '{a}' then array({', '.join(f'{x!r}D' for x in log_prior[a])})" for a in AXES) + " end"
    table = annotators.selectExpr(*KEYS, "l", f"{prior} as p")
    if few:
        met = ratings.join(F.broadcast(table), KEYS)
    else:
        busy = F.broadcast(annotators.where(F.expr("aggregate(n, 0.0D, (s, x) -> s + x)") > total / 1000).select(*KEYS))
        light = ratings.join(busy, KEYS, "left_anti").join(table, KEYS)
        met = ratings.join(F.broadcast(table.join(busy, KEYS, "left_semi")), KEYS).unionByName(light)
    scores = range(SCORES)
    item = "over (partition by sample_id, axis)"
    summed = met.selectExpr("sample_id", *KEYS, "score", *[f"sum(element_at(l, {t * SCORES} + score)) {item} + p[{t}] as s{t}" for t in scores])
    top = "greatest(" + ", ".join(f"s{t}" for t in scores) + ")"
    parts = summed.selectExpr("sample_id", *KEYS, "score", *[f"exp(s{t} - {top}) as e{t}" for t in scores])
    whole = " + ".join(f"e{t}" for t in scores)
    return parts.selectExpr("sample_id", *KEYS, "score", *[f"e{t} / ({whole}) as q{t}" for t in scores])


def _updated(posterior: DataFrame, before: DataFrame | None, few: bool, types: np.ndarray, weight: np.ndarray, strength: float) -> DataFrame:
    """The annotators' table after one variational update, summed and updated where the data is."""
    counts = posterior.groupBy(*KEYS).agg(*[F.expr(f"sum(if(score = {s + 1}, q{t}, 0.0D))").alias(f"n{t}{s}") for t in range(SCORES) for s in range(SCORES)])
    if before is None:
        counts = counts.withColumn("l", F.expr(f"array_repeat(0.0D, {SCORES * SCORES})"))
    else:
        last = before.select(*KEYS, "l")
        counts = counts.join(F.broadcast(last) if few else last, KEYS)

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            n = frame[[f"n{c}" for c in CELLS]].to_numpy(dtype=float).reshape(-1, SCORES, SCORES)
            shares = type_shares(n, types, weight)
            alpha = own_confusion(n, shares, types, strength)
            logs = digamma(alpha) - digamma(alpha.sum(axis=2, keepdims=True))
            old = np.stack(frame["l"]).reshape(-1, SCORES, SCORES)
            moved = np.abs(np.exp(logs) - np.exp(old)).max(axis=(1, 2))
            flat = SCORES * SCORES
            yield pd.DataFrame({"axis": frame["axis"], "judge_id": frame["judge_id"], "l": list(logs.reshape(-1, flat)), "n": list(n.reshape(-1, flat)), "k": list(shares), "moved": moved})

    return counts.mapInPandas(update, ANNOTATORS)


def _sums(annotators: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], float]:
    """Of all annotators: expected counts by type, the types' mass, true scores by axis, and the largest move.

    Each task adds up its own annotators; one array of fixed size per task reaches the driver.
    """
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_type, mass, totals, moved = np.zeros((len(SHAPES), SCORES, SCORES)), np.zeros(len(SHAPES)), np.zeros((len(AXES), SCORES)), 0.0
        for frame in frames:
            if not len(frame):
                continue
            n, shares = np.stack(frame["n"]).reshape(-1, SCORES, SCORES), np.stack(frame["k"])
            by_type += np.einsum("nm,nts->mts", shares, n)
            mass += shares.sum(axis=0)
            for i, axis in enumerate(AXES):
                totals[i] += n[(frame["axis"] == axis).to_numpy()].sum(axis=(0, 2))
            moved = max(moved, float(frame["moved"].max()))
        yield pd.DataFrame({"sums": [np.concatenate([by_type.ravel(), mass, totals.ravel()])], "moved": [moved]})

    got = annotators.mapInPandas(add, "sums array<double>, moved double").collect()
    kinds = len(SHAPES) * SCORES * SCORES
    flat = np.sum([np.array(r["sums"]) for r in got], axis=0) if got else np.zeros(kinds + len(SHAPES) + len(AXES) * SCORES)
    totals = flat[kinds + len(SHAPES) :].reshape(len(AXES), SCORES)
    return flat[:kinds].reshape(len(SHAPES), SCORES, SCORES), flat[kinds : kinds + len(SHAPES)], dict(zip(AXES, totals, strict=True)), max((r["moved"] for r in got), default=0.0)


def fit(judge_scores: DataFrame, rounds: int = 100, tolerance: float = 5e-3, strength: float = 8.0, broadcast_annotators: int = 50_000) -> Fit:
    """Fit the model.  No annotator counts fully on trust: all start from the vote shares of items.

    A round updates the items' posteriors, the annotators' matrices and types, and the types'
    matrices, all in the cluster; what reaches the driver are sums of a fixed size.  It ends when no
    entry of any annotator's matrix moves by ``tolerance``, or unconverged after ``rounds``; either
    is told by the result.  ``broadcast_annotators`` bounds the annotators' table that is broadcast
    (about 50 numbers each); beyond it the same updates run by joins.  An item has no more ratings
    than there are judges, since a judge's last one counts.
    """
    laid = final_ratings(judge_scores).repartition("sample_id", "axis").sortWithinPartitions("sample_id", "axis", "judge_id").persist()
    total = laid.count()
    few = small_enough(laid.select("judge_id").distinct(), broadcast_annotators)
    item = Window.partitionBy("sample_id", "axis")
    votes = [((F.sum((F.col("score") == t + 1).cast("double")).over(item) + 0.1) / (F.count(F.lit(1)).over(item) + 0.4)).alias(f"q{t}") for t in range(SCORES)]
    posterior = laid.select("sample_id", "axis", "judge_id", "score", *votes)
    types, weight = type_priors(), np.full(len(SHAPES), 1 / len(SHAPES))
    log_prior = {a: [0.0] * SCORES for a in AXES}
    annotators, done, moved = None, 0, float("inf") if total else 0.0
    while done < rounds and moved >= tolerance:
        before = annotators
        annotators = materialize(_updated(posterior, before, few, types, weight, strength), "annotators")
        forget(before)
        by_type, mass, totals, moved = _sums(annotators)
        types = type_priors() + by_type
        weight = (mass + 1) / (mass.sum() + len(SHAPES))
        for a in AXES:
            prior = totals[a] + 1
            log_prior[a] = [float(x) for x in np.log(prior / prior.sum())]
        posterior = _posterior(laid, annotators, log_prior, few, total)
        done += 1
    if annotators is None:
        annotators = judge_scores.sparkSession.createDataFrame([], ANNOTATORS)
    posterior = materialize(posterior.select("sample_id", "axis", "judge_id", "score", *[f"q{t}" for t in range(SCORES)]), "posterior")
    laid.unpersist()
    return Fit(posterior, annotators, log_prior, done, moved, moved < tolerance)


def consensus(judge_scores: DataFrame, **options) -> DataFrame:
    """One row per sample and axis: label, confidence, ratings, votes that differ, agreement.

    ``label`` is the most probable score, the smaller on a tie; ``confidence`` its posterior;
    ``agreement`` the share of pairs of ratings that are equal, null for a single rating.
    """
    fitted = fit(judge_scores, **options)
    same = sum(((F.col(f"v{s}") * (F.col(f"v{s}") - 1)) for s in range(2, SCORES + 1)), F.col("v1") * (F.col("v1") - 1))
    items = fitted.ratings.groupBy("sample_id", "axis").agg(
        F.count(F.lit(1)).alias("n_ratings"), F.min("score").alias("lowest"), F.max("score").alias("highest"), *[F.first(f"q{t}").alias(f"q{t}") for t in range(SCORES)], *[F.sum((F.col("score") == s).cast("long")).alias(f"v{s}") for s in range(1, SCORES + 1)]
    )
    best = F.greatest(*[F.col(f"q{t}") for t in range(SCORES)])
    label = F.coalesce(*[F.when(F.col(f"q{t}") == best, F.lit(t + 1)) for t in range(SCORES)]).cast("int")
    pairs = F.col("n_ratings") * (F.col("n_ratings") - 1)
    return items.select("sample_id", "axis", label.alias("label"), best.alias("confidence"), "n_ratings", "lowest", "highest", F.when(pairs > 0, same / pairs).alias("agreement"))


def contested(judge_scores: DataFrame) -> DataFrame:
    """``(sample_id, axis, label)`` where at least two final ratings differ."""
    return consensus(judge_scores).where("lowest < highest").select("sample_id", "axis", "label")


def reliability(judge_scores: DataFrame, **options) -> DataFrame:
    """Per judge and axis: the chance of giving the right score, ratings, and the most likely type."""
    annotators = fit(judge_scores, **options).annotators
    total = F.expr("aggregate(n, 0.0D, (s, x) -> s + x)")
    right = F.expr(" + ".join(f"n[{t * (SCORES + 1)}]" for t in range(SCORES)))
    return annotators.select("judge_id", "axis", (right / total).alias("reliability"), total.alias("n_ratings"), F.array_position("k", F.array_max("k")).cast("int").alias("judge_type"))


def convergence(judge_scores: DataFrame, **options) -> DataFrame:
    """One row on how the fit ended: rounds, the largest move of the last round, whether it converged."""
    fitted = fit(judge_scores, **options)
    return judge_scores.sparkSession.createDataFrame([(fitted.rounds, fitted.moved, fitted.converged)], "rounds int, moved double, converged boolean")


def published_agreement(judge_scores: DataFrame, annotations: DataFrame) -> DataFrame:
    """Mean agreement over the axes of a sample beside the published judge_agreement.

    Of several annotations the last counts; spellings are trimmed and lower-cased, other values than
    ``strong`` and ``weak`` are null.
    """
    ours = consensus(judge_scores).groupBy("sample_id").agg(F.avg("agreement").alias("agreement"), F.min("confidence").alias("confidence"))
    theirs = annotations.groupBy("sample_id").agg(F.max(F.struct("annotated_at", F.lower(F.trim("judge_agreement")).alias("a")))["a"].alias("a"))
    return ours.join(theirs, "sample_id", "left").select("sample_id", "agreement", "confidence", F.when(F.col("a").isin("strong", "weak"), F.col("a")).alias("published"))
