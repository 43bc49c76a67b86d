"""Shared helpers: written intermediates, Arrow maps over texts, word splitting and running totals."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that separates words everywhere in this package: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
_own_dir: list[str] = []
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="llm-"))
    return _own_dir[0]


class Scratch:
    """Written tables of one run. ``put`` writes a frame and rereads it; ``drop`` deletes a table that later steps don't read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of steps that are written and no longer referred to.

        The first collection frees the frames, the second the shuffles that they held.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Frames that are written inside pass at most ``rows`` rows at once to Python; for rows that hold many texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Give executors this package, as ``--py-files`` does, once in a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(packed))
    _shipped.add(sc.applicationId)


def arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType, timestamp_utc=True)


def add_columns(df: DataFrame, inputs: list[str], added: T.StructType, fn: Callable[..., dict], rows: int = 500, keep: str | None = None) -> DataFrame:
    """``df`` with the columns ``added`` that ``fn`` makes from the lists of values of ``inputs``.

    Rows pass through as Arrow data, untouched and in pieces of at most ``rows``. A column of the same name is replaced.
    With ``keep`` (one of ``added``, boolean) only the rows where it is true stay.
    """
    ship(df.sparkSession)
    fresh = {f.name for f in added}
    left = [f for f in df.schema if f.name not in fresh]
    kinds = [(f.name, arrow_type(f)) for f in added]
    names = [f.name for f in left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = fn(*[part.column(c).to_pylist() for c in inputs])
                out = pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(made[n], type=t) for n, t in kinds], names + [n for n, _ in kinds])
                yield out.filter(out.column(keep)) if keep else out

    return df.mapInArrow(run, T.StructType(left + list(added.fields)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until ``df`` has no such column (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, in the JVM. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed permutation of 64-bit values, one for each seed (the finaliser of splitmix64)."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64), 11)
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out
IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class TextBatch:
    """UTF-8 bytes of several whole texts, one after the other with a line feed behind each, and their words as arrays.

    Everything is computed on the batch at once. ``first[i]`` and ``last[i]`` bound text i in ``raw``. Null: empty.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(coded) + b"\n"
        self.raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() changes A-Z only
        size = np.array([len(c) for c in coded], np.int64)
        self.last = np.cumsum(size + 1) - 1
        self.first = self.last - size
        self.n = len(coded)
        gap = IS_SPACE[self.raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is white space, so edges pair up
        self.bounds = np.searchsorted(self.start, np.concatenate([self.first, [len(self.raw)]]))  # words of text i
        self.doc = np.repeat(np.arange(self.n), np.diff(self.bounds))
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        """Prefix sums of a polynomial in the bytes: the hash of any span is a difference of two of them."""
        if self._sums is None:
            up, _ = powers(len(self.raw))
            self._sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(BYTE_CODES[self.raw] * up[:len(self.raw)], out=self._sums[1:])
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, the same for the same bytes anywhere."""
        _, down = powers(len(self.raw))
        return mix64((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words inside one text, and the index of the first word of each."""
        n = len(ids) - size + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = mix64(h * np.uint64(0x100000001B3) + ids[at + k], k + 1)
        return h, at

    def shingles(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``windows``, but a text of fewer words is one window. Hashes and the text of each, ordered by text."""
        h, at = self.windows(ids, size)
        doc = self.doc[at]
        length = np.diff(self.bounds)
        short = np.flatnonzero((length > 0) & (length < size))
        if not len(short):
            return h, doc
        more = np.empty(len(short), np.uint64)
        for n in range(1, size):
            own = np.flatnonzero(length[short] == n)
            v = np.zeros(len(own), np.uint64)
            for k in range(n):
                v = mix64(v * np.uint64(0x100000001B3) + ids[self.bounds[short[own]] + k], k + 1)
            more[own] = mix64(v, 1000 + n)
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        return np.concatenate([h, more])[order], np.concatenate([doc, short])[order]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.last] - total[self.first]


def pieces(texts: list[str | None], chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of neighbouring texts with about ``chars`` characters; a longer text is a slice of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if held and held + n > chars:
            yield slice(start, k)
            start, held = k, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def running_total(df: DataFrame, scratch: Scratch, name: str, order: list[Column], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before this one in ``order`` (which must order all rows).

    Rows are dealt by range and written; each part is summed alone and starts at the total of the parts before it. No key
    holds a task together, whatever the order's columns are. The parts' totals are as many rows as there are partitions.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.put(name, df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return (dealt.join(F.broadcast(starts), "_part")
            .withColumn(out, (F.col("_start") + F.coalesce(F.sum(value).over(before), F.lit(0))).cast("long")).drop("_part", "_start"))


def one_text_per_id(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (id, text) with one row for each id that isn't null: of an id's several texts, the greatest.

    Texts are only shuffled if some id is repeated; a count of the ids alone tells.
    """
    docs = docs.filter("id IS NOT NULL")
    if not docs.groupBy("id").count().filter("count > 1").limit(1).count():
        return docs
    return scratch.put("one_text", docs.groupBy("id").agg(F.max("text").alias("text")))
