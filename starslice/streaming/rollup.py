"""In-season rollup: a growing stream of sample rows to samples and positives per entity and period."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.runtime import shared_dir

def sample_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """Files that match ``pattern`` as they land in ``folder``; the schema defaults to that of the landed files."""
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def event_time(df: DataFrame, column: str) -> Column:
    """The column as an instant; wall-clock times without a zone are read as UTC whatever the session's zone.

    A watermark needs instants, and daily windows are aligned to UTC days.
    """
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.concat(F.col(column).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(column)


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def windowed_rollup(samples: DataFrame, late: str = "2 days", period: str = "1 day") -> DataFrame:
    """Tumbling-window counts per entity; rows later than the watermark no longer change a closed window.

    ``samples`` has entity, ts and positive. The per-task partial aggregate runs before the state
    store, so one very busy entity does not overload its state partition.
    """
    return (
        samples.withWatermark("ts", late)
        .groupBy(F.window("ts", period).alias("w"), "entity")
        .agg(F.count("*").alias("samples"), F.sum("positive").alias("positives"))
        .select("entity", F.col("w.start").alias("period_start"), "samples", "positives")
    )


def run_available(rollup: DataFrame, target: str, checkpoint: str) -> None:
    """Process what has landed, writing each micro-batch's changed windows as one folder.

    A batch that is replayed after a failure overwrites its own folder, so the table stays exact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={batch_id:012d}")

    query = (
        rollup.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def live_table(spark: SparkSession, target: str, rollup_schema: T.StructType) -> DataFrame:
    """Current value of every window: the row of its latest micro-batch."""
    schema = T.StructType(rollup_schema.fields + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    last = F.max_by(F.struct("samples", "positives"), "batch_id").alias("v")
    return rows.groupBy("entity", "period_start").agg(last).select("entity", "period_start", "v.*")


def merge_closed(closed: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Closed periods and the live one as a single table; a closed row wins over a live row of the same key."""
    fresh = live.join(closed.select(*keys), keys, "left_anti")
    return closed.unionByName(fresh)


def rollup_folder(spark: SparkSession, folder: str, pattern: str, entities: int = 25) -> DataFrame:
    """Run the rollup over the files of a folder and return the resulting table."""
    root = shared_dir(spark)
    if root is None:
        raise RuntimeError("a streaming rollup needs spark.checkpoint.dir for its state and output")
    base = f"{root}/starslice/rollup-{uuid.uuid4().hex}"
    raw = sample_stream(spark, folder, pattern)
    samples = raw.select(
        F.pmod("user_id", F.lit(entities)).alias("entity"), event_time(raw, "ts").alias("ts"), (F.col("event_type") == "error").cast("long").alias("positive")
    )
    rollup = windowed_rollup(samples)
    run_available(rollup, f"{base}/out", f"{base}/state")
    return live_table(spark, f"{base}/out", rollup.schema)


def running_totals(rows: DataFrame) -> DataFrame:
    """Season-to-date samples and positives per entity after each period (one row per period and entity)."""
    w = W.partitionBy("entity").orderBy("period_start").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"cum_samples": F.sum("samples").over(w), "cum_positives": F.sum("positives").over(w)})
