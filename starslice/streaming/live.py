"""A live table of samples: micro-batches in any order, with late, repeated and corrected rows, counted exactly.

    <root>/segments/batch=../period=..   the rows of a micro-batch
    <root>/compact/batch=../period=..    one row a sample of closed periods, and <root>/sums/batch=../period=.. their counts
    <root>/manifest.json                 the last batch, and for each period its segments and its compacted part

A micro-batch is written once and listed in the manifest by one rename. A batch that is replayed after a failure overwrites its own folder, or is found
listed and left alone. A period is open while it has segments; only those rows are read to know its counts, one for each sample, the latest
batch's. A period older than the watermark is compacted: later reads take its stored counts. A row that comes later still opens its period again,
so nothing is dropped, and no state is held for periods that rest.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.sources.files import Folder

MANIFEST = "manifest.json"
SAMPLE = "entity bigint, sample_id bigint, positive bigint, batch bigint, period date"
SUMS = "entity bigint, samples bigint, positives bigint, period date"


class LiveSamples:
    """Samples (entity, period, sample_id, positive; ``period`` is a date) by period.

    A sample is known by its id within its period: of several rows the one of the latest batch counts, of equal ones in a batch the greatest. ``late``
    is the number of days that a period stays open behind the newest one. Rows without a period belong to none and are left out.
    """

    def __init__(self, spark: SparkSession, root: str, late: int = 2):
        self.spark, self.folder, self.late = spark, Folder(spark, root), timedelta(days=late)

    def manifest(self) -> dict:
        return self.folder.read_json(MANIFEST) or {"version": "none", "batch": -1, "periods": {}}

    def _put(self, now: dict, what: str) -> None:
        self.folder.put_json(MANIFEST, now | {"version": f"{what}-{now['batch']}"})

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Take a micro-batch, for ``foreachBatch``."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return  # replayed after it was listed
        of_sample = rows.filter("period IS NOT NULL").groupBy("period", "entity", "sample_id").agg(F.max("positive").alias("positive")).withColumn("batch", F.lit(batch_id).cast("long"))
        place = f"{self.folder.path}/segments/batch={batch_id:012d}"
        of_sample.select("entity", "sample_id", "positive", "batch", "period").write.mode("overwrite").partitionBy("period").parquet(place)
        for name in Folder(self.spark, place).folders():  # a batch's days
            entry = now["periods"].setdefault(name.partition("=")[2], {"segments": [], "compact": None})
            entry["segments"].append(batch_id)
        self._put(now | {"batch": batch_id}, "batch")
        self.compact()

    def _open_rows(self, periods: dict) -> DataFrame:
        """One row a sample of these periods."""
        paths = [f"{self.folder.path}/segments/batch={b:012d}/period={p}" for p, e in periods.items() for b in e["segments"]]
        paths += [f"{self.folder.path}/compact/batch={e['compact']:012d}/period={p}" for p, e in periods.items() if e["compact"] is not None]
        schema = T.StructType.fromDDL(SAMPLE)
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the folders name the period and, for segments, the batch; both are columns of the files or of the path
        found = self.spark.read.schema(T.StructType(schema.fields[:-1])).parquet(*paths)
        found = found.withColumn("period", F.regexp_extract(F.input_file_name(), r"period=(\d{4}-\d{2}-\d{2})", 1).cast("date"))
        latest = F.max_by(F.struct("entity", "positive"), F.struct("batch", "positive")).alias("v")
        return found.groupBy("period", "sample_id").agg(latest, F.max("batch").alias("batch")).select("v.entity", "sample_id", "v.positive", "batch", "period")

    def compact(self) -> list[str]:
        """Close the periods behind the watermark that have segments, and return them."""
        now = self.manifest()
        if not now["periods"]:
            return []
        newest = date.fromisoformat(max(now["periods"]))
        due = {p: e for p, e in now["periods"].items() if e["segments"] and date.fromisoformat(p) < newest - self.late}
        if not due:
            return []
        to = f"batch={now['batch']:012d}"
        self._open_rows(due).write.mode("overwrite").partitionBy("period").parquet(f"{self.folder.path}/compact/{to}")
        rows = self.spark.read.schema(SAMPLE).parquet(f"{self.folder.path}/compact/{to}")
        self._sums(rows).write.mode("overwrite").partitionBy("period").parquet(f"{self.folder.path}/sums/{to}")
        closed = {p: {"segments": [], "compact": now["batch"]} for p in due}
        self._put(now | {"periods": now["periods"] | closed}, "compact")
        return sorted(due)

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entity", "period").agg(F.count("*").alias("samples"), F.sum("positive").alias("positives")).select("entity", "samples", "positives", "period")

    def table(self) -> DataFrame:
        """(entity, samples, positives, period): the exact counts of all rows taken so far."""
        periods = self.manifest()["periods"]
        opened = self._sums(self._open_rows({p: e for p, e in periods.items() if e["segments"]}))
        resting: dict[int, list[str]] = {}
        for p, e in periods.items():
            if not e["segments"]:
                resting.setdefault(e["compact"], []).append(p)
        for batch, days in resting.items():
            stored = self.spark.read.schema(SUMS).parquet(f"{self.folder.path}/sums/batch={batch:012d}")
            opened = opened.unionByName(stored.filter(F.col("period").isin(*[date.fromisoformat(p) for p in days])))
        return opened


def run_available(samples: DataFrame, live: LiveSamples, checkpoint: str) -> None:
    """Take what has landed since the last run, in micro-batches."""
    query = samples.writeStream.foreachBatch(live.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
