"""Percentiles of very large numeric columns (problem 2).

A summary is a set of sorted buffers of ``k`` values; a buffer of level ``l`` stands for ``2**l``
values each.  Two full buffers of a level collapse into one of the next by keeping every second
position of their merge, which moves no rank by more than ``2**l``.  Nothing is random: the rank
error of a summary is counted as it is built and is reported with the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import materialize
from .dedupe import last_delivery


class Summary:
    """A mergeable summary: full buffers by level, a tail of single values, and the error so far."""

    def __init__(self, k: int) -> None:
        self.k, self.n, self.error = k, 0, 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.turn: dict[int, int] = {}
        self.tail: list[np.ndarray] = []
        self.waiting = 0

    def add(self, values: np.ndarray) -> None:
        """Take in values, none of them NaN."""
        self.n += len(values)
        self.tail.append(values)
        self.waiting += len(values)
        if self.waiting >= self.k:
            loose = np.concatenate(self.tail)
            whole = len(loose) // self.k * self.k
            for chunk in loose[:whole].reshape(-1, self.k):
                self._put(0, np.sort(chunk))
            self.tail, self.waiting = [loose[whole:]], len(loose) - whole

    def _put(self, level: int, buffer: np.ndarray) -> None:
        while True:
            here = self.full.setdefault(level, [])
            here.append(buffer)
            if len(here) < 2:
                return
            merged = np.sort(np.concatenate(here), kind="stable")
            here.clear()
            # Odd and even positions by turns, so that the errors of one level do not add up one way.
            start = self.turn.get(level, 0)
            self.turn[level] = 1 - start
            self.error += 1 << level
            buffer, level = merged[start::2], level + 1

    def merge(self, other: Summary) -> None:
        """Take in another summary of the same ``k``; errors add up."""
        self.error += other.error
        for level in sorted(other.full):
            for buffer in other.full[level]:
                self.n += self.k << level
                self._put(level, buffer)
        for values in other.tail:
            self.add(values)

    def quantiles(self, q: Sequence[float]) -> list[float]:
        """The value at rank ``ceil(q * n)``, within the counted error; NaN of nothing."""
        if not self.n:
            return [math.nan] * len(q)
        values, upto = self._cumulated()
        return [float(x) for x in values[np.minimum(np.searchsorted(upto, _ranks(q, self.n)), len(values) - 1)]]

    def brackets(self, q: Sequence[float]) -> tuple[list[float], list[float]]:
        """Below and above: the value at rank ``ceil(q * n)`` is certainly greater than the one and not greater than the other."""
        values, upto = self._cumulated()
        # Of equal values the last one has the rank of them all.
        last = np.flatnonzero(np.r_[values[1:] != values[:-1], np.ones(min(1, len(values)), dtype=bool)])
        ends, ranks = np.r_[-math.inf, values[last], math.inf], _ranks(q, self.n)
        return [float(x) for x in ends[np.searchsorted(upto[last], ranks - self.error)]], [float(x) for x in ends[1 + np.searchsorted(upto[last], ranks + self.error)]]

    def _cumulated(self) -> tuple[np.ndarray, np.ndarray]:
        """The values held, sorted, and how many values stand up to each."""
        values = np.concatenate([*self.tail, *[b for bs in self.full.values() for b in bs]])
        weights = np.concatenate([*[np.ones(len(t), dtype=np.int64) for t in self.tail], *[np.full(len(b), 1 << lv, dtype=np.int64) for lv, bs in self.full.items() for b in bs]])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def held(self) -> int:
        """How many values the summary holds."""
        return self.waiting + self.k * sum(len(bs) for bs in self.full.values())

    def dump(self) -> tuple[int, int, list[int], np.ndarray]:
        """``n``, ``error``, the level of each full buffer, and all values: buffers, then the tail."""
        levels = [lv for lv in sorted(self.full) for _ in self.full[lv]]
        return self.n, self.error, levels, np.concatenate([*[b for lv in sorted(self.full) for b in self.full[lv]], *self.tail, np.empty(0)])

    @classmethod
    def load(cls, k: int, n: int, error: int, levels: Iterable[int], values: np.ndarray) -> Summary:
        """The inverse of :meth:`dump`."""
        out, at = cls(k), 0
        for level in levels:
            out.full.setdefault(int(level), []).append(values[at : at + k])
            at += k
        out.tail, out.waiting, out.n, out.error = [values[at:]], len(values) - at, int(n), int(error)
        return out


def _ranks(q: Sequence[float], n: int) -> np.ndarray:
    return np.maximum(1, np.ceil(np.asarray(q) * n - 1e-9))


def _schema(frame: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [frame.schema[c] for c in keys]
    return T.StructType([*fields, T.StructField("metric", T.StringType()), T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("error", T.LongType()), T.StructField("levels", T.ArrayType(T.IntegerType())), T.StructField("vals", T.ArrayType(T.DoubleType()))])


def _partitions(rows: DataFrame) -> int:
    """No fewer than the partitions that a plan can have: those of its shuffles, or those its input splits into."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scans = min(10_000_000, size // max(1, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    return max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), scans)


def summaries(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int = 4096, fan_in: int = 16, held: int = 2_000_000) -> DataFrame:
    """One summary per group and metric: ``keys``, metric, n, error, levels, vals.

    Null, NaN, infinite and negative values are unknown and left out; a group without any value has
    no summary.  Each partition first summarises its own rows of every group, so a group that holds
    a third of all rows costs each task its share.  A task holds at most about ``held`` values: beyond
    that it passes on all summaries that it has and starts new ones.  The parts merge in a tree of
    about ``fan_in``, streaming by: a task holds one summary at a time.
    """
    keys = list(keys)
    narrow = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    schema = _schema(narrow, keys)

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, full = TaskContext.get().partitionId(), 0
        found: dict[tuple, Summary] = {}

        def passed_on() -> Iterator[pd.DataFrame]:
            listed = list(found.items())
            for at in range(0, len(listed), 512):
                yield _frame(((*name, m, part, *s.dump()) for (name, m), s in listed[at : at + 512]), schema)
            found.clear()

        for frame in frames:
            if not len(frame):
                continue
            codes, names = pd.MultiIndex.from_frame(frame[keys]).factorize()
            for m in metrics:
                values = frame[m].to_numpy(dtype=float)
                good = np.isfinite(values) & (values >= 0)
                order = np.argsort(codes[good], kind="stable")
                sorted_codes, sorted_values = codes[good][order], values[good][order]
                cuts = np.flatnonzero(np.diff(sorted_codes)) + 1
                for code, chunk in zip(sorted_codes[np.r_[0, cuts]] if len(sorted_codes) else [], np.split(sorted_values, cuts), strict=False):
                    name = tuple(None if pd.isna(x) else x for x in names[code])
                    found.setdefault((name, m), Summary(k)).add(chunk)
                    full += len(chunk)
            # What is added bounds what is held; after a count only what is held counts.
            if full > held:
                full = sum(s.held() for s in found.values())
                if 2 * full > held:
                    yield from passed_on()
                    full = 0
        yield from passed_on()

    parts = narrow.mapInPandas(leaf, schema)
    width = _partitions(narrow)
    while width > fan_in:
        width = -(-width // fan_in)
        dealt = parts.withColumn("part", F.pmod(F.col("part"), F.lit(width)))
        parts = _merged(dealt, [*keys, "metric", "part"], schema, k)
    return _merged(parts, [*keys, "metric"], schema, k).drop("part")


def _merged(parts: DataFrame, by: list[str], schema: T.StructType, k: int) -> DataFrame:
    """The summaries of each group of ``by`` merged into one.

    Groups lie together in a partition, sorted, and stream by: one summary is held at a time.
    """
    names = [c for c in schema.names if c not in ("part", "n", "error", "levels", "vals")]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, whole, part = None, None, 0
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                now = tuple(None if pd.isna(x) else x for x in (getattr(row, c) for c in by))
                if whole is None or now != key:
                    if whole is not None:
                        done.append((*[label[c] for c in names], part, *whole.dump()))
                    key, whole, part = now, Summary(k), int(row.part)
                    label = {c: None if pd.isna(getattr(row, c)) else getattr(row, c) for c in names}
                whole.merge(Summary.load(k, row.n, row.error, row.levels, np.asarray(row.vals, dtype=float)))
            if done:
                yield _frame(done, schema)
        if whole is not None:
            yield _frame([(*[label[c] for c in names], part, *whole.dump())], schema)

    return parts.repartition(*by).sortWithinPartitions(*by).mapInPandas(merge, schema)


def roll_up(found: DataFrame, keys: Sequence[str], k: int = 4096, fan_in: int = 64) -> DataFrame:
    """Summaries of coarser groups from those of finer ones, such as configurations from days.

    The parts of a coarse group merge in rounds of ``fan_in``, as many as the largest group needs.
    """
    keys = list(keys)
    schema = _schema(found, keys)
    rest = [c for c in found.columns if c not in {*keys, "metric", "n", "error", "levels", "vals"}]
    most = found.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    parts = found.withColumn("part", F.xxhash64(*rest) if rest else F.lit(0).cast("long")).select(*schema.names)
    while most > fan_in:
        most = -(-most // fan_in)
        parts = _merged(parts.withColumn("part", F.pmod(F.col("part"), F.lit(most))), [*keys, "metric", "part"], schema, k)
    return _merged(parts, [*keys, "metric"], schema, k).drop("part")


def read_quantiles(found: DataFrame, keys: Sequence[str], q: Sequence[float] = (0.5, 0.9, 0.95, 0.99), k: int = 4096) -> DataFrame:
    """``keys``, metric, n, one column per quantile, and ``rank_error``: ranks are off by no more."""
    return _told(found, list(keys), q, k).drop("below", "above")


def _told(found: DataFrame, keys: list[str], q: Sequence[float], k: int) -> DataFrame:
    """The columns of :func:`read_quantiles`, and ``below`` and ``above``: the brackets of a summary with an error, else null."""
    names, doubles = [f"p{round(100 * x)}" for x in q], T.ArrayType(T.DoubleType())
    schema = T.StructType([*[found.schema[c] for c in [*keys, "metric", "n"]], *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("rank_error", T.LongType()), T.StructField("below", doubles), T.StructField("above", doubles)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[[*keys, "metric", "n"]].copy()
            held = [Summary.load(k, n, e, lv, np.asarray(v, dtype=float)) for n, e, lv, v in zip(frame["n"], frame["error"], frame["levels"], frame["vals"], strict=True)]
            got = [s.quantiles(q) for s in held]
            for i, name in enumerate(names):
                out[name] = [g[i] for g in got]
            out["rank_error"] = frame["error"]
            ends = [s.brackets(q) if s.error else (None, None) for s in held]
            for i, name in enumerate(("below", "above")):
                out[name] = pd.Series([e[i] for e in ends], index=out.index, dtype=object)
            yield out

    return found.select(*keys, "metric", "n", "error", "levels", "vals").mapInPandas(read, schema)


def exact_quantiles(rows: DataFrame, found: DataFrame, keys: Sequence[str], metrics: Sequence[str], q: Sequence[float] = (0.5, 0.9, 0.95, 0.99), k: int = 4096) -> DataFrame:
    """As :func:`read_quantiles` with ``rank_error`` 0: where a summary has one, its rows are counted once more.

    A summary tells between which two values each quantile lies.  Values in no such bracket count as
    the next lower end of one, so few distinct values of a group are cumulated, however many its rows.
    ``rows`` are those that ``found`` summarises.
    """
    keys, names = list(keys), [f"p{round(100 * x)}" for x in q]
    told = materialize(_told(found, keys, q, k), "brackets")
    sure = told.where("rank_error = 0").drop("below", "above")
    rough = told.where("rank_error > 0").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("metric").alias("__metric"), "n", "below", "above")
    if rough.isEmpty():
        return sure
    same = F.col("metric") == F.col("__metric")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.lit(False)
    for i in range(len(names)):
        inside = inside | ((F.col("v") > F.col("below")[i]) & (F.col("v") <= F.col("above")[i]))
    # No lower end that a value is raised to lies in a bracket of a smaller quantile, so every count up to a value in a bracket stays right.
    cell = F.when(inside, F.col("v")).otherwise(F.array_min(F.filter("below", lambda x: x >= F.col("v"))))
    counted = _long(rows, keys, metrics).join(rough, same).groupBy(*keys, "metric", "n", cell.alias("v")).agg(F.count(F.lit(1)).alias("m")).where("v is not null")
    upto = counted.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys, "metric").orderBy("v")))
    exact = upto.groupBy(*keys, "metric", "n").agg(*[F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(x) - F.lit(1e-9))), F.col("v"))).alias(name) for x, name in zip(q, names, strict=True)])
    return sure.unionByName(exact.withColumn("rank_error", F.lit(0).cast("long")))


def _long(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys``, metric, v: a row per known value."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(*keys, "x.metric", "x.v").where("v >= 0 and not isnan(v) and v < double('infinity')")


def within_bounds(rows: DataFrame, read: DataFrame, keys: Sequence[str], metrics: Sequence[str], q: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """``keys``, metric, n, ``within``: whether the true ranks of all quantiles read lie within ``rank_error``.

    One pass over the rows counts, per group and quantile, the values below it and up to it.
    """
    keys, names = list(keys), [f"p{round(100 * x)}" for x in q]
    told = read.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("metric").alias("__metric"), F.col("n").alias("__n"), F.col("rank_error").alias("__error"), *[F.col(c).alias(f"__{c}") for c in names])
    same = F.col("metric") == F.col("__metric")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    counted = _long(rows, keys, metrics).join(told, same).groupBy(*keys, "metric", "__n", "__error").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, c in enumerate(names) for k, f, x in (("b", F.count_if, F.col("v") < F.col(f"__{c}")), ("u", F.count_if, F.col("v") <= F.col(f"__{c}")))])
    good = F.col("n") == F.col("__n")
    for i, x in enumerate(q):
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(x) - F.lit(1e-9)))
        good = good & (F.col(f"b{i}") < rank + F.col("__error")) & (F.col(f"u{i}") >= rank - F.col("__error"))
    return counted.select(*keys, "metric", "n", good.alias("within"))


def _frame(rows: Iterable[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=schema.names).astype({"part": "int64", "n": "int64", "error": "int64"})


def run_measures(results: DataFrame) -> DataFrame:
    """Each run once, in its last delivery: config_id, day, latency_ms, total_cost_usd."""
    last = last_delivery(results, ["result_id"], ["ingested_at"], ["config_id", "observed_at", "latency_ms", "total_cost_usd"])
    return last.select("config_id", F.to_date("observed_at").alias("day"), F.col("latency_ms").cast("double").alias("latency_ms"), "total_cost_usd")


def daily_summaries(results: DataFrame, k: int = 4096) -> DataFrame:
    """A summary per configuration and day; runs without a time have the day null."""
    return summaries(run_measures(results), ["config_id", "day"], ["latency_ms", "total_cost_usd"], k)
