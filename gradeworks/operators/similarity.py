"""Similarity joins: hashes within a Hamming distance, nearest neighbours, kernels and distances."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import forget, materialize


def simhash(words: Column) -> Column:
    """A 64-bit fingerprint of an array of words as a signed number; like texts get like ones.

    A bit is set where more than half of the words' MD5 hashes have it set.
    """
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 16), 16, -10).cast("long"))

    def votes(bound: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.aggregate(bound, F.lit(0), lambda s, h: s + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)))

    # The hashes are bound to a variable: the words are hashed once, not once for each bit.
    bits = F.flatten(F.transform(F.array(hashes), votes))
    return F.conv(F.array_join(F.transform(F.reverse(bits), lambda b: F.when(b > 0, F.lit("1")).otherwise(F.lit("0"))), ""), 2, -10).cast("long")


#: Values that are compared all with all before they are cut further, and how many comparisons are held at once.
_WHOLE, _HELD = 4096, 1 << 18


def _close(values: np.ndarray, rest: list[int], apart: list[int], more: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of distinct ``values`` within the distance that differ in every block of ``apart``: smaller, larger, distance.

    Many values are cut by the first block of ``rest`` that a pair agrees in, up to ``more`` times.
    """
    if more and len(values) > _WHOLE:
        for i in range(len(rest) - more + 1):
            part = values & np.int64(rest[i])
            order = np.argsort(part)
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for own in np.split(values[order], cuts):
                if len(own) > 1:
                    yield from _close(own, rest[i + 1 :], apart + rest[:i], more - 1, distance)
        return
    values = np.sort(values)
    bits = values.view(np.uint64)
    step = max(1, _HELD // len(values))
    for at in range(0, len(values) - 1, step):
        off = bits[at : at + step, None] ^ bits[None, at + 1 :]
        row, column = np.nonzero(np.bitwise_count(off) <= distance)
        upper = column >= row
        row, column = row[upper], column[upper]
        found = off[row, column]
        for mask in apart:
            good = found & np.uint64(mask % (1 << 64)) != 0
            row, column, found = row[good], column[good], found[good]
        if len(found):
            yield values[at + row], values[at + 1 + column], np.bitwise_count(found).astype(np.int32)


def near_hashes(hashes: DataFrame, identity: str, value: str, distance: int = 8, keep: int | None = None) -> DataFrame:
    """Links between distinct 64-bit values within a Hamming distance: smaller value, larger, distance.

    Values are cut into ``distance + keep`` blocks; two within the distance agree in ``keep`` of them.
    Values that share a block, or two blocks where there are more than a million values, lie together
    in a partition and are compared there; where they are many they are first cut by further blocks,
    up to ``keep`` (3 unless given), which changes no result.  Nothing is broadcast: the shuffle holds
    each value a fixed number of times, a task those of one key at a time, eight bytes each.  A pair
    is told by its first agreeing blocks alone, so none is found twice.  Equal values are one node:
    their rows are its members.
    """
    nodes = materialize(hashes.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct(), "hashes")
    keep = keep or 3
    spark, number, blocks = hashes.sparkSession, nodes.count(), distance + keep
    first = min(keep, 1 if number <= 1_000_000 else 2)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]) for i in range(blocks)]
    choices = list(itertools.combinations(range(distance + first), first))
    # Comparing takes the time, not the bytes: partitions follow the cores and the rows.
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), number * len(choices) // 2_000_000)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("v").bitwiseAND(F.lit(sum(masks[b] for b in chosen))).alias("part")) for t, chosen in enumerate(choices)])
    cut = nodes.repartition(width, "v").select("v", F.explode(keys).alias("k")).select("v", "k.t", "k.part")
    close = _close

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(t: int, values: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            last = choices[t][-1]
            yield from close(np.concatenate(values), masks[last + 1 :], [masks[b] for b in range(last) if b not in choices[t]], keep - first, distance)

        def groups() -> Iterator[tuple[int, list[np.ndarray]]]:
            key, held = None, []
            for frame in frames:
                t, part, v = (frame[c].to_numpy() for c in ("t", "part", "v"))
                starts = np.r_[0, np.flatnonzero((np.diff(t) != 0) | (part[1:] != part[:-1])) + 1, len(v)]
                for a, b in itertools.pairwise(starts.tolist()):
                    if a == b:
                        continue
                    if key != (now := (int(t[a]), int(part[a]))):
                        if key:
                            yield key[0], held
                        key, held = now, []
                    held.append(v[a:b])
            if key:
                yield key[0], held

        told, rows = [], 0
        for t, values in groups():
            for some in found(t, values):
                told.append(some)
                rows += len(some[0])
                if rows >= 1 << 17:
                    yield pd.DataFrame(dict(zip(("a", "b", "distance"), map(np.concatenate, zip(*told, strict=True)), strict=True)))
                    told, rows = [], 0
        if told:
            yield pd.DataFrame(dict(zip(("a", "b", "distance"), map(np.concatenate, zip(*told, strict=True)), strict=True)))

    return cut.repartition(width, "t", "part").sortWithinPartitions("t", "part").mapInPandas(pairs, "a long, b long, distance int")


def _roots(up: DataFrame) -> DataFrame:
    """Every ``v`` with the end of its chain of ``up``, each of which is a ``v``; chains halve in every round."""
    while True:
        far = up.select(F.col("v").alias("at"), F.col("up").alias("far"))
        jumped = materialize(up.join(far, up["up"] == far["at"]).select("v", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "roots")
        forget(up)
        up = jumped
        if up.where("moved").isEmpty():
            return up


def near_members(hashes: DataFrame, identity: str, value: str, distance: int = 8) -> DataFrame:
    """One row per member: identity, its value, the class of its value and how many links its value has.

    The class is the smallest value reached over links; members of one value are in one class
    without a link between them.  Every value hooks on to its least neighbour, chains of hooks are
    followed to their ends, and links between ends are all that the next round reads: links are read
    by the first round alone.
    """
    rows = materialize(hashes.where(F.col(value).isNotNull()).select(F.col(identity), F.col(value)), "prints")
    links = materialize(near_hashes(rows, identity, value, distance), "links")
    told: DataFrame | None = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = materialize(both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("links")).select(F.col("a").alias("v"), F.least("a", "least").alias("up"), "links"), "hooks")
        ends = _roots(own.select("v", "up"))
        if told is None:
            told = materialize(own.join(ends.select("v", F.col("up").alias("class")), "v").select("v", "class", "links"), "classes")
        else:
            end = ends.select(F.col("v").alias("class"), "up")
            moved = materialize(told.join(end, "class", "left").select("v", F.coalesce("up", "class").alias("class"), "links"), "classes")
            forget(told)
            told = moved
        low, high = (ends.select(F.col("v").alias(c), F.col("up").alias(f"{c}_end")) for c in ("a", "b"))
        left = materialize(links.join(low, "a").join(high, "b").where("a_end != b_end").select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "links")
        forget(links, own, ends)
        links = left
        if links.isEmpty():
            break
    forget(links)
    told = told.withColumnRenamed("v", "__v")
    named = rows.join(told, F.col(value) == F.col("__v"), "left")
    return named.select(F.col(identity), F.col(value).alias("fingerprint"), F.coalesce("class", value).alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def neighbours(queries: DataFrame, base: DataFrame, identity: str, vector: str, k: int, block: int = 2048, most: int = 100_000) -> DataFrame:
    """The ``k`` nearest rows of ``base`` by cosine for every query: query, neighbour, rank, cosine.

    The queries are a stated set; they are broadcast in blocks of about ``most``, every partition of
    the base multiplies its own rows with a block and keeps ``k`` a query, and those meet.
    Vectors of length zero have no neighbours; ties go to the smaller id.
    """
    listed = queries.where(F.col(vector).isNotNull()).select(F.col(identity).cast("long").alias("id"), F.col(vector).alias("vector"))
    parts = max(1, -(-listed.count() // most))
    found: DataFrame | None = None
    for p in range(parts):
        own = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        one = _nearest(own, base, identity, vector, k, block)
        found = one if found is None else found.unionByName(one)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _nearest(queries: DataFrame, base: DataFrame, identity: str, vector: str, k: int, block: int) -> DataFrame:
    """Of each partition of ``base`` the ``k`` nearest rows of every query."""
    rows = queries.collect()
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    q = np.array([r[1] for r in rows], dtype=float) if rows else np.zeros((0, 1))
    norm = np.linalg.norm(q, axis=1) if rows else np.zeros(0)
    ids, q = ids[norm > 0], q[norm > 0] / norm[norm > 0][:, None]
    shared = base.sparkSession.sparkContext.broadcast((ids, q))
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("neighbour_id", T.LongType()), T.StructField("cosine", T.DoubleType())])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for frame in frames:
            x = np.stack([np.asarray(v, dtype=float) for v in frame[vector]]) if len(frame) else np.zeros((0, 1))
            size = np.linalg.norm(x, axis=1)
            own, x = frame[identity].to_numpy(dtype=np.int64)[size > 0], x[size > 0] / size[size > 0][:, None]
            if not len(own) or not len(ids):
                continue
            order = np.argsort(own, kind="stable")
            own, x = own[order], x[order]
            for at in range(0, len(ids), block):
                cosine = np.round(q[at : at + block] @ x.T, 9)
                cosine[ids[at : at + block][:, None] == own[None, :]] = -2
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids[at : at + block], top.shape[1]), "neighbour_id": own[top].ravel(), "cosine": np.take_along_axis(cosine, top, axis=1).ravel()})

    return base.where(F.col(vector).isNotNull()).select(F.col(identity).cast("long").alias(identity), vector).mapInPandas(search, out).where("cosine > -2")


def kernel_width(vectors: DataFrame, identity: str, vector: str, size: int = 2000, seed: int = 42) -> DataFrame:
    """The median pairwise distance over the first ``size`` vectors in hash order; 1 without a pair.

    The sample is the definition of the width: it is a parameter, not a cut of the result.
    """
    from .sampling import hash_order

    picked = vectors.where(F.col(vector).isNotNull()).orderBy(hash_order(identity, seed), identity).limit(size).agg(F.collect_list(vector).alias("all"))

    @F.pandas_udf("double")
    def median(all_: pd.Series) -> pd.Series:
        out = []
        for rows in all_:
            x = np.stack([np.asarray(v, dtype=float) for v in rows]) if len(rows) > 1 else np.zeros((1, 1))
            square = (x * x).sum(axis=1)
            d = np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T)[np.triu_indices(len(x), 1)]
            out.append(float(np.sqrt(np.median(d))) if len(d) else 1.0)
        return pd.Series(out)

    return picked.select(F.round(median("all"), 6).alias("sigma"))
