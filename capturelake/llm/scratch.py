"""Tables written between the steps of an operator.

A step is written as Parquet below the shared folder named by ``spark.checkpoint.dir`` and read back.  That cuts the
lineage, survives lost executors, and lets Spark delete a step's shuffle files as soon as the step is written.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Settings of a write whose join is to be filtered by the ids of ``save_ids``.
BLOOM = {f"spark__sql__optimizer__runtime__bloomFilter__{k}": v for k, v in (("applicationSideScanSizeThreshold", "0"), ("creationSideThreshold", "1GB"))}

#: Rows of an Arrow batch sent to Python: texts can be long, so batches are short.
BATCH_ROWS = 256

#: Bits of a ``KeyFilter``: for each key, and at most (8 MB).
KEY_BITS, MOST_BITS = 12, 1 << 26


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master may fall back to a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="capturelake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def quoted(name: str) -> str:
    """A column's name as a reference that dots and backticks do not break."""
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it while a column of ``taken`` goes by it in some case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def give_back_memory() -> None:
    """Returns what this process has freed to the system; a driver keeps its memory for long otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on.

    Plans read the setting when they are executed, which is after an operator has returned; so it stays in the session, and
    every operator sets it: what one gives does not depend on which ran before.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (``__`` stands for a dot) that hold while a table is written, and the former ones behind it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class KeyFilter:
    """A Bloom filter of keys, as an array of longs that a scalar subquery hands to every task: a key sets up to four bits of
    one word.

    Rows that it does not hold need no join with the keys; those it holds do, since it may err that way.
    """

    def __init__(self, table: DataFrame, words: int) -> None:
        self.table, self.words = table, words

    @staticmethod
    def place(keys: list[str], words: int) -> tuple[Column, Column]:
        """The word of a key, and its bits there."""
        h, one = F.xxhash64(F.lit(0), *(F.col(quoted(c)) for c in keys)), F.lit(1).cast("long")
        bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (40, 46, 52, 58)]
        return h.bitwiseAND(F.lit(words - 1)), reduce(Column.bitwiseOR, bits)

    def holds(self, *keys: str) -> Column:
        """Whether a row's keys may be among those of the filter; true wherever they are.  It is never null."""
        at, bits = self.place(list(keys), self.words)
        return F.get(self.table.scalar(), at.cast("int")).bitwiseAND(bits) == bits


class Scratch:
    """Folder of one operator run; it goes when the driver's JVM ends, and single tables when they are dropped."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        short_batches(spark)
        path, fs = self._hadoop(self.folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _hadoop(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, **values: str) -> DataFrame:
        """Writes ``df`` and reads it back; its shuffle files go once it is written.  ``values`` are settings of the write."""
        with settings(self.spark, **{_CLEAN.replace(".", "__"): "true"}, **values):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        give_back_memory()
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def save_ids(self, ids: DataFrame, name: str) -> DataFrame:
        """Writes distinct ids (the first column is a long) so that a join with them filters the other side by a Bloom filter
        first, when it is saved with BLOOM.

        Spark builds that filter only from a side with a predicate, hence the one that always holds; the filter's size
        is bounded by spark.sql.optimizer.runtime.bloomFilter.maxNumBits, and the join itself stays exact.
        """
        return self.save(ids.distinct(), name).where(F.col(ids.columns[0]) > -(1 << 63))

    def save_filter(self, keys: DataFrame, name: str) -> KeyFilter:
        """A filter of all columns of the saved table ``keys``.  Its size is bounded: with very many keys it holds more rows."""
        words, most = 1, KEY_BITS * keys.count()
        while 64 * words < min(MOST_BITS, most):
            words *= 2
        at, bits = KeyFilter.place(keys.columns, words)
        some = keys.select(at.alias("id"), bits.alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
        every = self.spark.range(words).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        one = every.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("x")).select(F.col("x.bits").alias("bits"))
        return KeyFilter(self.save(one, name), words)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._hadoop(f"{self.folder}/{name}")
            fs.delete(path, True)
