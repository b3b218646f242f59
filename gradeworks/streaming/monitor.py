"""A monitor over a growing log of results, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import scratch_path


def tail(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a log, a folder or one file; what was read is kept in the query's checkpoint."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    where, name = (path, "*.parquet") if folder else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(where)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key, closed once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", F.round("total", 4).alias("total"))


def flags(events: DataFrame, rules: dict, keys: list[str]) -> DataFrame:
    """One row per rule that a record breaks; ``rules`` maps names to conditions."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return events.select(*keys, F.explode(broken).alias("flag"))


def new_flags(found: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each flag of a key once, with state bounded by the watermark."""
    return found.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, "flag"])


def run_to_end(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there, exactly once, and read the table that it wrote."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
