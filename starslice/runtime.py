"""Session helpers: the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def local_session(cores: str = "8", partitions: int = 8, app: str = "starslice") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    shared_dir(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: what the session names in ``spark.checkpoint.dir``.

    A local session that names none gets a folder of its own, set in the session and deleted with the process. On a cluster the
    setting is required, because executors cannot see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="starslice-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Used where a plan needs the same (aggregated) rows several times: the input is then
    scanned once, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/starslice/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Settle independent frames; their write jobs are submitted together and share the executors."""
    if len(frames) < 2:
        return {k: settle(df, k) for k, df in frames.items()}
    with ThreadPoolExecutor(len(frames)) as pool:
        waiting = {k: pool.submit(settle, df, k) for k, df in frames.items()}
        return {k: f.result() for k, f in waiting.items()}


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows written in code (pins, vocabularies) as a relation of known size, which the planner may broadcast."""
    fields = [part.split() for part in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def ratio(num, den):
    """num / den where den > 0, else NULL (never NaN or infinity)."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(d > 0, n.cast("double") / d)
