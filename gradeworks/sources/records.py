"""Line-delimited JSON: strict, tolerant and optional readers, sinks, and resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path names something."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every record; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType, key: str | None = None) -> DataFrame:
    """Well-formed records only, and of those the ones with a key."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if key is None else rows.where(F.col(key).isNotNull() & (F.col(key) != ""))


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a path, none if it is absent."""
    return read_strict(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_many(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """All files of a pattern with ``file``, ``block`` and ``line``: ordered by them, records come as a reader of files by name meets them.

    ``block`` is where a split of a file starts and orders the splits of a file; ``line`` orders the
    records of a split, which one task reads in order, and says nothing between splits.  Malformed and blank lines are dropped.  Raises if no file matches.
    """
    if not exists(spark, pattern):
        raise FileNotFoundError(pattern)
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    text = spark.read.text(pattern).select(*place, F.col("value").alias("raw"))
    parsed = text.where(F.trim("raw") != "").select("file", "block", "line", F.from_json("raw", schema).alias("r"))
    some = F.array_size(F.array_compact(F.array(*[F.col(f"r.{c}").cast("string") for c in schema.names]))) > 0
    return parsed.where(some).select("file", "block", "line", "r.*")


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id`` of a JSON document that is a list of ids; its count is that of the rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("sample_id"))


def write_report(report: DataFrame, path: str) -> None:
    """A report of named figures as JSON documents in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_text(report: DataFrame, path: str, title: str) -> str:
    """A report table of bounded size as aligned text: written to a folder and given back."""
    names = report.columns
    rows = [["" if v is None else str(v) for v in r] for r in report.limit(1000).collect()]
    wide = [max(len(x[i]) for x in [names, *rows]) for i in range(len(names))]
    lines = [title, "=" * len(title), *["  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in [names, *rows]]]
    report.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return "\n".join(lines)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def append(rows: DataFrame, path: str) -> None:
    """Add records to a folder; the commit protocol stands for locks."""
    rows.write.mode("append").json(path)


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace a folder's records; columns that start with an underscore are not written."""
    rows.select(*[c for c in rows.columns if not c.startswith("_")]).write.mode("overwrite").json(path)


def remaining(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output is complete."""
    return exists(spark, f"{path}/_SUCCESS")
