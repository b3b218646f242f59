"""Routers with one protocol: a name, ``fit`` on training rows, ``predict`` a configuration for others.

Rows have sample_id, x (features), tier, composite, target (the cheapest correct configuration, null
without one), and right_1..3: whether the cheapest configuration of each tier is correct; prices are
those of :mod:`.evaluation`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import budget_for
from ..workspace import materialize
from . import evaluation, networks


class Router(Protocol):
    """What every router offers."""

    name: str

    def fit(self, train: DataFrame) -> Router: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


class StaticRouter:
    """Always the cheapest, always the dearest, or one at random."""

    def __init__(self, prices: DataFrame, kind: str) -> None:
        self.prices, self.name = prices, kind

    def fit(self, train: DataFrame) -> StaticRouter:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return evaluation.static_routes(rows, self.prices, self.name)


def _by_tier(rows: DataFrame, prices: DataFrame, tier: Column) -> DataFrame:
    return evaluation.tier_routes(rows.select("sample_id", tier.alias("tier")), prices)


class ThresholdRouter:
    """Two cuts of the composite, one for each step between tiers, that route most rows right.

    Rows are counted by distinct composite; running sums over these give the best pair of cuts in
    one pass, without trying all pairs on the rows.
    """

    name = "threshold"

    def __init__(self, prices: DataFrame) -> None:
        self.prices, self.cuts = prices, (1.5, 2.5)

    def fit(self, train: DataFrame) -> ThresholdRouter:
        by = train.where("target is not null and composite is not null").groupBy("composite").agg(*[F.sum(F.coalesce(f"right_{t}", F.lit(False)).cast("long")).alias(f"r{t}") for t in (1, 2, 3)])
        run = Window.orderBy("composite")
        # Right with the first cut at i and the second at j: r1 up to i, r2 up to j beyond i, r3 beyond j.
        sums = by.select("composite", *[F.sum(f"r{t}").over(run).alias(f"s{t}") for t in (1, 2, 3)])
        lead = F.max(F.struct((F.col("s1") - F.col("s2")).alias("g"), (-F.col("composite")).alias("c"))).over(run.rowsBetween(Window.unboundedPreceding, -1))
        best = sums.withColumn("lead", lead).where("lead is not null").select((F.col("lead.g") + F.col("s2") - F.col("s3")).alias("hits"), (-F.col("lead.c")).alias("one"), F.col("composite").alias("two")).orderBy(F.desc("hits"), "one", "two").first()
        if best is not None:
            self.cuts = (best["one"], best["two"])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        c = F.col("composite")
        return _by_tier(rows, self.prices, F.when(c <= self.cuts[0], 1).when(c <= self.cuts[1], 2).when(c.isNotNull(), 3))


def _scaled(train: DataFrame):
    return StandardScaler(inputCol="__v", outputCol="features", withMean=True, withStd=True).fit(train.withColumn("__v", array_to_vector("x")))


class LogisticConfigRouter:
    """Multinomial logistic regression for the cheapest correct configuration."""

    name = "logistic"

    def __init__(self, configs: Sequence[str], rounds: int = 30) -> None:
        self.configs, self.rounds, self.model = list(configs), rounds, None

    def fit(self, train: DataFrame) -> LogisticConfigRouter:
        label = F.array_position(F.array(*map(F.lit, self.configs)).cast("array<string>"), F.col("target")) - 1
        known = train.where("target is not null").withColumn("label", label.cast("double")).where("label >= 0")
        if not known.isEmpty():
            self.scaler = _scaled(known)
            self.model = LogisticRegression(maxIter=self.rounds, family="multinomial").fit(self.scaler.transform(known.withColumn("__v", array_to_vector("x"))))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        listed = F.array(*map(F.lit, self.configs)).cast("array<string>")
        if self.model is None:
            return rows.select("sample_id", F.get(listed, F.lit(0)).alias("config_id"))
        out = self.model.transform(self.scaler.transform(rows.withColumn("__v", array_to_vector("x"))))
        return out.select("sample_id", F.get(listed, F.col("prediction").cast("int")).alias("config_id"))


class LearnedCascade:
    """Two logistic gates: may tier A answer, may tier B; their thresholds are tuned on a grid."""

    name = "learned_cascade"

    def __init__(self, prices: DataFrame, rounds: int = 30, start: float = 0.1, step: float = 0.05, steps: int = 16) -> None:
        self.prices, self.rounds, self.grid = prices, rounds, (start, step, steps)
        self.thresholds, self.gates = (0.5, 0.5), None

    def fit(self, train: DataFrame) -> LearnedCascade:
        if train.isEmpty():
            return self
        self.scaler = _scaled(train)
        ready = self.scaler.transform(train.withColumn("__v", array_to_vector("x")))
        gates = []
        for t in (1, 2):
            labelled = ready.withColumn("label", F.coalesce(f"any_{t}", F.lit(False)).cast("double"))
            gates.append(LogisticRegression(maxIter=self.rounds).fit(labelled) if labelled.select("label").distinct().count() > 1 else None)
        self.gates = gates
        start, step, steps = self.grid

        def cell(c: str) -> Column:
            return F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(c) - start) / step + 1e-9))).cast("int")

        counted = self._chances(train).groupBy(cell("p1").alias("a"), cell("p2").alias("b")).agg(*[F.sum(F.coalesce(f"right_{t}", F.lit(False)).cast("long")).alias(f"r{t}") for t in (1, 2, 3)])
        sums = np.zeros((3, steps + 1, steps + 1))
        for r in counted.collect():
            sums[:, r["a"] + 1, r["b"] + 1] = [r["r1"], r["r2"], r["r3"]]
        best = None
        for i in range(steps):
            for j in range(steps):
                hits = sums[0, i + 1 :].sum() + sums[1, : i + 1, j + 1 :].sum() + sums[2, : i + 1, : j + 1].sum()
                if best is None or hits > best[0]:
                    best = (hits, start + i * step, start + j * step)
        self.thresholds = best[1:]
        return self

    def _chances(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("__v", array_to_vector("x"))
        out = self.scaler.transform(out)
        for t, gate in enumerate(self.gates, 1):
            if gate is None:
                out = out.withColumn(f"p{t}", F.lit(0.5))
                continue
            out = gate.transform(out).withColumn(f"p{t}", F.round(vector_to_array("probability")[1], 9)).drop("probability", "rawPrediction", "prediction")
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.gates is None:
            return _by_tier(rows, self.prices, F.lit(1))
        a, b = self.thresholds
        return _by_tier(self._chances(rows), self.prices, F.when(F.col("p1") >= a, 1).when(F.col("p2") >= b, 2).otherwise(3))


def standardised(train: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with x brought to mean 0 and deviation 1 by the training rows' moments, one aggregate."""
    names = range(width)
    got = train.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in names], *[F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in names]).first()
    return rows.withColumn("x", F.array(*[(F.col("x")[i] - F.lit(got[f"m{i}"] or 0.0)) / F.lit(got[f"d{i}"] or 1.0) for i in names]))


class CostSensitiveNetwork:
    """A network over configurations whose loss weighs cheap ones more."""

    name = "cost_sensitive"

    def __init__(self, price_of: Mapping[str, float], width: int, hidden: Sequence[int] = (32,), rounds: int = 40, seed: int = 42) -> None:
        self.configs = sorted(price_of)
        inverse = np.array([1.0 / (price_of[c] + 1e-6) for c in self.configs])
        self.weights = (1.0 + inverse / inverse.max() if len(inverse) else inverse).tolist()
        self.width, self.rounds = width, rounds
        self.layers = networks.fresh([width, *hidden, max(1, len(self.configs))], seed)
        self.train: DataFrame | None = None

    def fit(self, train: DataFrame) -> CostSensitiveNetwork:
        self.train = train
        at = (F.array_position(F.array(*map(F.lit, self.configs)).cast("array<string>"), F.col("target")) - 1).cast("int") if self.configs else F.lit(None).cast("int")
        known = standardised(train, train.where("target is not null").select("sample_id", "x", at.alias("y")), self.width).where("y >= 0")
        self.layers = networks.train(materialize(known, "network"), "x", self.layers, networks.class_loss(self.weights, "y"), self.rounds)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = networks.apply(standardised(self.train, rows.select("sample_id", "x"), self.width), "x", self.layers)
        best = (F.array_position("out", F.array_max("out")) - 1).cast("int")
        return out.select("sample_id", F.get(F.array(*map(F.lit, self.configs)).cast("array<string>"), best).alias("config_id"))


class TwoPhaseNetwork:
    """A network that picks a model and a budget, trained on fully observed rows, then on partly observed ones.

    ``models`` lists the models, ``budgets`` the tokens of their budget levels, ``config_of`` the
    configuration of a model and budget.  Rows beside the features have model (index, -1 without),
    budget_targets (NaN where unknown), full (whether all configurations were tried) and seen (share
    of configurations tried): in the second phase a row weighs as the inverse of that share.
    """

    name = "two_phase"

    def __init__(self, models: Sequence[str], config_of: Mapping[tuple[str, int], str], width: int, hidden: Sequence[int] = (32,), rounds: Sequence[int] = (25, 15), seed: int = 42, most_weight: float = 5.0) -> None:
        self.models, self.config_of, self.width, self.rounds, self.most = list(models), dict(config_of), width, tuple(rounds), most_weight
        self.layers = networks.fresh([width, *hidden, 2 * max(1, len(self.models))], seed)
        self.train: DataFrame | None = None

    def fit(self, train: DataFrame) -> TwoPhaseNetwork:
        self.train = train
        ready = materialize(standardised(train, train, self.width).withColumn("weight", F.least(F.lit(self.most), 1.0 / F.greatest(F.col("seen"), F.lit(1e-6)))).select("x", "model", "budget_targets", "full", "weight"), "network")
        n = max(1, len(self.models))
        first = networks.choice_and_budget_loss(n, "model", "budget_targets")
        second = networks.choice_and_budget_loss(n, "model", "budget_targets", "weight")
        self.layers = networks.train(ready.where("full"), "x", self.layers, first, self.rounds[0])
        self.layers = networks.train(ready.where("not full"), "x", self.layers, second, self.rounds[1], rate=0.01)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        n = max(1, len(self.models))
        out = networks.apply(standardised(self.train, rows.select("sample_id", "x"), self.width), "x", self.layers)
        choice = F.slice("out", 1, n)
        picked = out.select("sample_id", (F.array_position(choice, F.array_max(choice)) - 1).cast("int").alias("m"), "out")
        picked = picked.withColumn("log_tokens", F.get("out", F.col("m") + n))
        config = F.lit(None).cast("string")
        for i, model in enumerate(self.models):
            budgets = sorted(b for m, b in self.config_of if m == model)
            if not budgets:
                continue
            own = budget_for(F.col("log_tokens"), budgets)
            told = F.lit(None).cast("string")
            for b in budgets:
                told = F.when(own == b, F.lit(self.config_of[model, b])).otherwise(told)
            config = F.when(F.col("m") == i, told).otherwise(config)
        return picked.select("sample_id", config.alias("config_id"))


def choose_k(votes: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per k the share of rows that the most frequent label of their k nearest neighbours gets right, best first.

    ``votes`` has id, rank, label (the neighbour's) and target; ties go to the smaller label, then to
    the smaller k.
    """
    tried = votes.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    told = tried.groupBy("k", "id", "target", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("k", "id", "target").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("voted"))
    return told.groupBy("k").agg(F.round(F.avg((F.col("voted") == F.col("target")).cast("double")), 6).alias("accuracy")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), "k")))
