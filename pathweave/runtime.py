"""What every operator needs from the session: shared storage for cut lineage, shipped code, spread work, skew-safe lookups."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: A key is heavy when it holds more than 1/HEAVY of the rows, so there are at most HEAVY heavy keys.
HEAVY = 1000
#: Parts that the rows of a heavy key are joined in.
SALTS = 256

#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package as a zip file, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    files = sorted(PACKAGE.rglob("*.py"))
    digest = hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    folder = tempfile.mkdtemp(prefix="pathweave-code-")  # on the driver, which serves it to the executors
    path = os.path.join(folder, f"pathweave_{digest}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "pathweave-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor then costs a re-read, not a recomputation of the loop.

    Each table is dropped as soon as its caller says so; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pathweave-{name}-{uuid.uuid4().hex[:12]}"
        self.steps = 0
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, codec: str = "zstd", by: str | None = None) -> tuple[DataFrame, str]:
        """Write df as Parquet, in a folder for each value of a column if by names one, and return it as read back, with its path."""
        self.steps += 1
        path = f"{self.root}/{self.steps:04d}"
        out = df.write.option("compression", codec)
        with self._shuffles_dropped():
            (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            self._remove(path)

    @contextmanager
    def _shuffles_dropped(self) -> Iterator[None]:
        """What is written needs its shuffle files no more: Spark then deletes them at once, not when the driver happens to collect garbage."""
        was = self.spark.conf.get(CLEANUP, "false")
        try:
            self.spark.conf.set(CLEANUP, "true")
            yield
        finally:
            self.spark.conf.set(CLEANUP, was)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the application has ended, or another did it
            pass


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Repartition rows ahead of per-row Python work when the scan has fewer tasks than the cluster has cores; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)


def heavy_keys(df: DataFrame, key: str, total: int | None = None) -> list:
    """The keys of df that hold more than 1/HEAVY of its rows (at most HEAVY of them), counted over all rows with map-side combining."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1000").select(key, "n_rows")
    most = sizes.orderBy(F.desc("n_rows"), key).limit(HEAVY).collect()
    if not most:
        return []
    n = df.count() if total is None else total
    return [r[0] for r in most if r[1] > n // HEAVY]


def lookup(left: DataFrame, key: str, table: DataFrame, table_key: str, heavy: list | None, how: str = "inner", hashed_join: bool = False) -> DataFrame:
    """Join left with a table that is unique on its key, with the rows of left's heavy keys salted.

    heavy has at most some thousand keys. Their rows of left go to SALTS parts by a hash of the row, their rows of the table to all of
    these: one shuffle, and no task gets more than a share of a key. hashed_join spares the sort where both sides are large and a
    partition of the table, which is even as its key is unique, fits in memory.
    """
    cols = [c for c in table.columns if c != table_key]
    t = table.withColumnRenamed(table_key, "__k")
    if not heavy:
        t = t.hint("shuffle_hash") if hashed_join else t
        return left.join(t, left[key] == t["__k"], how).select(*left.columns, *cols)
    none = F.lit(0).cast("bigint")
    salted = left.withColumn("__s", F.when(F.col(key).isin(heavy), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(none))
    more = t.filter(F.col("__k").isin(heavy)).withColumn("__t", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    parts = t.withColumn("__t", none).unionByName(more)
    parts = parts.hint("shuffle_hash") if hashed_join else parts
    return salted.join(parts, (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__t")), how).select(*left.columns, *cols)


def hashed(seed: int) -> Callable[..., Column]:
    """A 64-bit hash of columns."""
    return lambda *columns: F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.lit("|"), F.col(c))))


def identified(rows: DataFrame, columns: list[str], scratch: Scratch, more: Callable[[Callable[..., Column]], list[Column]] | None = None, seeds: int = 8) -> tuple[DataFrame, str, int]:
    """(v, ...) written, its path and the seed: rows, distinct in columns, under 64-bit hashes of these, with what more makes of the hash
    function, or with the columns.

    Whether two rows share a hash is tested on all of them, and another seed is taken if so.
    """
    for seed in range(seeds):
        key = hashed(seed)
        out, path = scratch.write(rows.select(key(*columns).alias("v"), *(more(key) if more else columns)))
        if out.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return out, path, seed
        scratch.drop(path)
    raise RuntimeError("no seed keeps the 64-bit hashes apart")


#: Characters that str.strip() removes: ASCII blanks and controls, and the Unicode spaces.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column | str) -> Column:
    """The value without white space at its ends (all of Unicode's, not only spaces)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def filled(c: Column | str) -> Column:
    """The stripped value, null where nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(columns), each evaluated once a row: what is built on them refers to their values.

    Stacked projections are merged by the optimizer and filters pushed below them, and an expression used in several places of the
    next step would be evaluated in each; a generator between the steps stays where it is.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
