"""Top N items within every group (problem 4).

The items are clustered: dealt into buckets by group, written sorted by group and score, with small
row groups that carry their minimum and maximum.  Each bucket is then read in the order of its row
groups' best scores, and a row group is skipped when it lies strictly beyond the current N-th score
of every group that it can contain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..workspace import forget, materialize, scratch_path
from .dedupe import last_delivery


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file written by Spark."""
    uri = uri.replace("s3a://", "s3://", 1)
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def read_top(source, group: str, order: list[str], n: int, stats: dict[str, int] | None = None) -> pa.Table:
    """The first ``n`` rows of every group in one clustered file, by ``order`` ascending.

    ``source`` is an open file.  Row groups come in the order of their smallest leading score.  One
    is skipped when that lies strictly beyond the current N-th score of every group that it holds;
    rows at the N-th score itself are still read, since the tie rule decides between them.  Which
    groups a row group holds is told by its statistics where they name one, else by its column of
    groups, which is read alone.
    """
    reader = pq.ParquetFile(source)
    meta = reader.metadata
    if not meta.num_rows:
        return reader.read(columns=[group, *order])
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    plan = []
    for k in range(meta.num_row_groups):
        score, name = (meta.row_group(k).column(at[c]).statistics for c in (order[0], group))
        best = score.min if score is not None and score.has_min_max else None
        # String bounds may be truncated by a writer; only equal bounds that a whole value can have are used.
        only = [name.min] if name is not None and name.has_min_max and name.min == name.max and not name.null_count else None
        plan.append((best is not None, best, k, only))
    plan.sort(key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    parts: list[pa.Table] = []
    # Of every group met its first rows; groups with n of them also their N-th score.
    best_of: dict[object, pa.Table] = {}
    nth: dict[object, object] = {}
    told = stats if stats is not None else {}
    for known, best, k, only in plan:
        held = only
        if held is None and known and nth:
            held = pc.unique(reader.read_row_group(k, columns=[group])[group]).to_pylist()
        if known and held is not None and all(g in nth and best > nth[g] for g in held):
            told["skipped"] = told.get("skipped", 0) + 1
            continue
        told["read"] = told.get("read", 0) + 1
        first = _first_n(reader.read_row_group(k, columns=[group, *order]), group, order, n)
        if only is None:
            parts.append(first)
            counts = first[group].value_counts()
            full = [c["values"] for c in counts.to_pylist() if c["counts"] == n]
            if full:
                last = first.filter(pc.is_in(first[group], value_set=pa.array(full, first[group].type)))
                for g, score in zip(last[group].to_pylist()[n - 1 :: n], last[order[0]].to_pylist()[n - 1 :: n], strict=True):
                    nth[g] = min(score, nth[g]) if g in nth else score
        else:
            mine = best_of.get(only[0])
            best_of[only[0]] = mine = first if mine is None else _first_n(pa.concat_tables([mine, first]), group, order, n)
            if mine.num_rows >= n:
                nth[only[0]] = mine[order[0]][n - 1].as_py()
    return _first_n(pa.concat_tables([*parts, *best_of.values()]), group, order, n)


def _first_n(rows: pa.Table, group: str, order: list[str], n: int) -> pa.Table:
    """The first ``n`` rows of each group, sorted by group and ``order``."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(group, "ascending"), *[(c, "ascending") for c in order]]))
    codes = pc.rank(rows[group].combine_chunks(), sort_keys="ascending", tiebreaker="min").to_numpy()
    position = pd.Series(range(len(codes))).to_numpy() + 1 - codes
    return rows.filter(pa.array(position < n))


def top_n(items: DataFrame, group: str, order: list[str], n: int, bucket_rows: int = 2_000_000, row_group_bytes: int = 1 << 20) -> DataFrame:
    """``group`` and ``order`` columns of the first ``n`` rows of every group, by ``order`` ascending.

    ``order`` must break all ties that matter; rows equal in all of it are alike.  A null group is a
    group; a null score sorts last and NaN above all numbers, so callers filter both.  Rows are
    dealt to buckets by group and a salt, so a group that holds a third of all rows is spread over
    as many buckets as its size asks for; the few rows each bucket keeps are ranked once more.
    """
    partial = _partial(items, group, order, n, bucket_rows, row_group_bytes)
    if partial is None:
        return items.select(group, *order).limit(0)
    ranked = Window.partitionBy(group).orderBy(*[F.asc_nulls_last(c) for c in order])
    return partial.where("file is null").withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= n).select(group, *order)


def skipping(items: DataFrame, group: str, order: list[str], n: int, bucket_rows: int = 2_000_000, row_group_bytes: int = 1 << 20) -> DataFrame:
    """``(file, row_groups_read, row_groups_skipped)`` of each clustered file that :func:`top_n` reads."""
    partial = _partial(items, group, order, n, bucket_rows, row_group_bytes)
    if partial is None:
        return items.sparkSession.createDataFrame([], "file string, row_groups_read long, row_groups_skipped long")
    return partial.where("file is not null").select("file", "row_groups_read", "row_groups_skipped")


#: Keys whose rows are salted; no more can hold as large a part of all rows.
HEAVY = 20_000


def _partial(items: DataFrame, group: str, order: list[str], n: int, bucket_rows: int, row_group_bytes: int) -> DataFrame | None:
    """The first ``n`` rows of every group in each clustered file, and one row per file on what was skipped."""
    spark = items.sparkSession
    narrow = materialize(items.select(group, *order), "narrow")
    total = narrow.count()
    if not total:
        return None
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // bucket_rows))
    # At most 4 * buckets groups hold so many rows, and never more than HEAVY.
    heavy = narrow.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1000, total // min(4 * buckets, HEAVY)))
    heavy = heavy.select(F.col(group).alias("__heavy"), (F.col("__n") * buckets * 4 / total + 1).cast("long").alias("__salts"))
    salted = narrow.join(F.broadcast(heavy), F.col(group).eqNullSafe(F.col("__heavy")), "left")
    salt = F.pmod(F.xxhash64(*order), F.coalesce("__salts", F.lit(1)))
    path = scratch_path(spark, "clustered")
    (
        salted.withColumn("__salt", salt)
        .repartition(buckets, group, "__salt")
        .sortWithinPartitions(F.asc_nulls_first(group), *[F.asc_nulls_last(c) for c in order])
        .select(group, *order)
        .write.option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )
    schema = T.StructType([*narrow.schema, T.StructField("file", T.StringType()), T.StructField("row_groups_read", T.LongType()), T.StructField("row_groups_skipped", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def told(source, name: str) -> Iterator[pa.RecordBatch]:
        stats: dict[str, int] = {}
        top = read_top(source, group, list(order), n, stats)
        for c in ("file", "row_groups_read", "row_groups_skipped"):
            top = top.append_column(c, pa.nulls(top.num_rows, arrow_schema.field(c).type))
        yield from top.cast(arrow_schema).to_batches()
        row = {c: [None] for c in arrow_schema.names} | {"file": [name.rsplit("/", 1)[-1]], "row_groups_read": [stats.get("read", 0)], "row_groups_skipped": [stats.get("skipped", 0)]}
        yield from pa.table(row, schema=arrow_schema).to_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _open(uri)
                with system.open_input_file(path) as source:
                    yield from told(source, uri)

    def read_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from told(pa.BufferReader(content.as_buffer()), name.as_py())

    files = sorted(spark.read.schema(narrow.schema).parquet(path).inputFiles())
    forget(narrow)
    try:
        _open(files[0])
    except (pa.ArrowException, OSError, ValueError):
        # A folder that only Spark can open: it brings the bytes of each file, which is no larger than a bucket.
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "content").repartition(len(files)).mapInArrow(read_bytes, schema)
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(read, schema)


def qualifying_runs(results: DataFrame) -> DataFrame:
    """The last delivery of each run, if it is correct and its cost is known."""
    last = last_delivery(results, ["result_id"], ["ingested_at"], ["result_id", "sample_id", "config_id", "is_correct", "total_cost_usd"])
    cost = F.col("total_cost_usd")
    return last.where(F.col("is_correct") & cost.isNotNull() & ~F.isnan(cost) & (cost >= 0))


def cheapest_correct_runs(results: DataFrame, n: int = 3) -> DataFrame:
    """``(sample_id, result_id)`` of the ``n`` cheapest correct runs of every sample."""
    runs = qualifying_runs(results).select("sample_id", "total_cost_usd", "config_id", "result_id")
    return top_n(runs, "sample_id", ["total_cost_usd", "config_id", "result_id"], n).select("sample_id", "result_id")


def skipped_row_groups(results: DataFrame, n: int = 3) -> DataFrame:
    """What :func:`cheapest_correct_runs` reads and skips, file by file."""
    runs = qualifying_runs(results).select("sample_id", "total_cost_usd", "config_id", "result_id")
    return skipping(runs, "sample_id", ["total_cost_usd", "config_id", "result_id"], n)
