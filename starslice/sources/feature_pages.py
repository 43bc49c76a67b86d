"""Landed result pages of a feature service as a data source: partitions of some page files, a given schema, filters applied while a page is read.

    spark = register(session)
    spark.read.format("feature_pages").schema("OBJECTID long, county string").load(folder)

A page is a JSON object with ``features``, a list of objects that hold ``attributes``; a service's ``error`` object is an error. A column takes the
attribute of its name, null where a feature lacks it; a value that doesn't fit its type is an error. Any folder that the file systems
of Arrow can reach may be read; its files are listed once and each is opened by the task that reads it;
a task reads one page at a time.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
PRIMITIVE = ("byte", "short", "integer", "long", "float", "double", "string", "boolean")  # types whose JSON values compare as Spark's do


FILES, BYTES = 200, 32_000_000  # that a partition holds at most; a larger page is a partition of its own
TASKS = 64  # partitions there are at least, if there are as many pages


@dataclass
class PageFiles(InputPartition):
    paths: list[str]


def dealt(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Paths in order, cut where a partition would get too many files or bytes."""
    files = max(1, min(FILES, len(sizes) // TASKS))
    out, held = [], 0
    for path, size in sizes:
        if not out or len(out[-1]) >= files or held + size > BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


class FeaturePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> str:
        raise ValueError("give the schema of the attributes")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.kinds, self.path, self.arrow, self.kept = {f.name: f.dataType.typeName() for f in schema}, path, to_arrow_schema(schema), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of plain columns with a value are applied here; the others stay with Spark."""
        for f in filters:
            plain = len(f.attribute) == 1 and self.kinds.get(f.attribute[0]) in PRIMITIVE if hasattr(f, "attribute") else False
            if plain and isinstance(f, (*COMPARED, In, IsNotNull)):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[PageFiles]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [PageFiles([scheme + p for p in paths]) for paths in dealt(files)]

    def keeps(self, row: dict) -> bool:
        for f in self.kept:
            value = row.get(f.attribute[0])
            if value is None:
                return False
            if isinstance(f, In) and value not in f.value or type(f) in COMPARED and not COMPARED[type(f)](value, f.value):
                return False
        return True

    def read(self, partition: PageFiles | None) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition else []:  # a folder without files has no partition
            yield self.page(path)

    def page(self, path: str) -> pa.RecordBatch:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(inner) as stream:
            page = json.loads(stream.read())
        if "error" in page:
            raise ValueError(f"{path}: the service answered {page['error']}")
        rows = [r for r in (f["attributes"] for f in page.get("features", [])) if self.keeps(r)]
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in self.arrow], schema=self.arrow)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with filter pushdown for Python data sources."""
    spark.dataSource.register(FeaturePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def feature_pages(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of all landed pages of one table."""
    return register(spark).read.format("feature_pages").schema(schema).load(path)


def unfinished(spark: SparkSession, path: str) -> DataFrame:
    """One row if the pages of a folder end before the service's last one: exactly one page has no ``exceededTransferLimit``."""
    flags = spark.read.schema("exceededTransferLimit boolean").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    ends = flags.agg(F.count_if(~F.coalesce("exceededTransferLimit", F.lit(False))).alias("last_pages"), F.count("*").alias("pages"))
    return ends.filter("last_pages <> 1")


def write_pages(rows: DataFrame, path: str, order: str, size: int = 2000) -> None:
    """Land a table as a service would send it: pages of ``size`` rows in ``order``, which must be 0, 1, 2, ..; one file a page."""
    paged = rows.withColumn("page", F.floor(F.col(order) / size).cast("int"))
    last = paged.agg(F.max("page")).scalar()
    feature = F.struct(F.col(order).alias("o"), F.struct(F.struct(*rows.columns).alias("attributes")).alias("f"))
    made = paged.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(feature)), lambda r: r["f"]).alias("features"))
    text = F.to_json(F.struct("features", (F.col("page") < last).alias("exceededTransferLimit")), {"ignoreNullFields": "false"})
    made.select("page", text.alias("value")).repartition("page").write.partitionBy("page").text(path)
