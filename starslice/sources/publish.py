"""Published tables: staged versions with a manifest, checks on the staged rows, and one pointer that is swapped.

    <root>/versions/<version>/species=../season_year=../season=..   the rows of a version
    <root>/current.json                                              which version is valid, with its manifest

A version is written whole and reread; what was written is compared with what is there; the rules run over the staged rows, the ones that readers
would get. Only then the pointer is replaced, by one rename. Until that moment, and after any failure, readers get the version before. The folders
of a version prune a scan by species, period and season, and the manifest lists the periods, so nothing has to be scanned to know them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starslice.operators.quality import GateClosed, gate
from starslice.plans.spec import Calendar
from starslice.sources.files import Folder
from starslice.sources.star import Star

FOLDERS = ("species", "season_year", "season")
ORDER = (*FOLDERS, "portion", "entity", "class")
POINTER, VERSIONS = "current.json", "versions"

Rules = Callable[[DataFrame], dict[str, DataFrame]]


def write_layout(fact: DataFrame, path: str, mode: str = "errorifexists", seen: Observation | None = None) -> None:
    """Zstandard Parquet in folders by species, period and season.

    Range partitioning keeps the rows of a file close together (good row-group statistics) and cuts a species or period that holds most of
    the rows into as many files as any other stretch of that size. ``seen`` gets the number and the digest of the rows that go to the files.
    """
    ranged = fact.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    if seen is not None:  # behind the shuffle, whose sample reads the rows once more
        ranged = ranged.observe(seen, F.count(F.lit(1)).alias("rows"), _digest(ranged).alias("digest"))
    ranged.write.mode(mode).option("compression", "zstd").partitionBy(*FOLDERS).parquet(path)


def _digest(df: DataFrame):
    """A sum over row hashes that neither order nor partitions change."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")


def publish(df: DataFrame, root: str, rules: Rules | None = None) -> str:
    """Publish the rows of ``df`` (columns of ``sinks.FACT_SCHEMA``) as the new version of a table, all or nothing. Returns the version.

    ``rules`` gets the staged rows and returns violation rows by name of the rule. Any violation, and any difference between the rows written and
    the rows staged, drops the staged version and raises ``GateClosed``. An error while writing leaves an unreferenced folder, which ``prune`` deletes.
    """
    spark = df.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    folder, staged = Folder(spark, root), f"{VERSIONS}/{version}"
    seen = Observation(f"published-{version}")
    write_layout(df, f"{folder.path}/{staged}", seen=seen)
    written = {"rows": seen.get["rows"], "digest": seen.get["digest"]}
    there = spark.read.schema(df.schema).parquet(f"{folder.path}/{staged}").select(*df.columns)
    found = there.agg(F.count(F.lit(1)).alias("rows"), _digest(there).alias("digest")).first().asDict()
    failed = [] if found == written else [f"staged rows differ from those written: {found} {written}"]
    if rules is not None:
        broken = gate(rules(there)).filter(F.col("violations") > 0).collect()  # one row per rule
        failed += [f"{r['rule']}: {r['violations']}" for r in broken]
    if failed:
        folder.delete(staged)
        raise GateClosed("; ".join(failed))
    # one row for each folder: the catalogue of the version
    parts = there.groupBy(*FOLDERS).agg(F.count(F.lit(1)).alias("rows"), F.sum("cnt").alias("cnt")).orderBy(*FOLDERS).collect()
    folder.put_json(POINTER, {"version": version, "schema": df.schema.jsonValue(), **written, "folders": [p.asDict() for p in parts]})
    return version


def manifest(spark: SparkSession, root: str) -> dict:
    """The manifest of the valid version."""
    found = Folder(spark, root).read_json(POINTER)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return found


def published(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the valid version. Filters on species, period and season choose folders."""
    now = manifest(spark, root)
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{VERSIONS}/{now['version']}").select(*schema.names)


def calendar(spark: SparkSession, root: str, species: str) -> Calendar:
    """The periods of one species and their seasons, from the manifest."""
    seasons: dict[int, list[str]] = {}
    for part in manifest(spark, root)["folders"]:
        if part["species"] == species:
            seasons.setdefault(part["season_year"], []).append(part["season"])
    return Calendar(tuple((y, tuple(sorted(s))) for y, s in sorted(seasons.items())))


def published_star(spark: SparkSession, root: str, species: str, dim: DataFrame, small: bool = False, **side: DataFrame) -> Star:
    """The star of one species over the valid version: its slices choose folders, and look-backs are counted in the manifest's periods."""
    rows = published(spark, root).withColumn("season_year", F.col("season_year").cast("int"))
    return Star(rows, dim, small=small, calendar=calendar(spark, root, species), **side).only(species)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete versions older than the valid one but for the ``keep`` newest of them, and return their names.

    Versions newer than the valid one may still be in the making, and are kept.
    """
    valid = manifest(spark, root)["version"]
    folder = Folder(spark, f"{root.rstrip('/')}/{VERSIONS}")
    old = [v for v in folder.folders() if v < valid]
    gone = old[:max(0, len(old) - keep)]
    for version in gone:
        folder.delete(version)
    return gone
