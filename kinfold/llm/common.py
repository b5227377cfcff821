"""Helpers shared by the corpus operators: shared scratch tables, column names, lets."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the contracts: space, and U+0009 to U+000D.
WORD_SEP = r"[\x20\x09-\x0D]+"

_written: list[str] = []
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh one in local mode only."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    return _local_root


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, kept in mind for :func:`clear`."""
    path = f"{scratch_root(spark)}/kinfold-{uuid.uuid4().hex}-{tag}"
    _written.append(path)
    return path


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables written so far. Results that still read them must be used before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the scratch tables written inside, also after a failure; so write results inside."""
    before = len(_written)
    try:
        yield
    finally:
        clear(spark, before)


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (names compare without case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col(quoted(name))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, as no lambda body re-evaluates it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SEP, -1), "")


#: A key that holds more than one in so many of a side's rows is hot, and dealt out over so many parts.
HOT_KEYS, DEALS = 20_000, 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``key`` of those rows of ``counts`` whose ``n`` is a share of ``total`` that makes them hot:
    at most ``HOT_KEYS``, so that they can be broadcast."""
    return counts.where(F.col(n) * HOT_KEYS >= max(total, HOT_KEYS * DEALS)).select(key)


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The inner join on ``key`` of a side with hot keys and one with a row per key: rows of a hot
    key are dealt out over ``DEALS`` tasks, its row of ``right`` to each of them."""
    deal, flag = fresh([*left.columns, *right.columns], "deal"), fresh([*left.columns, *right.columns], "is_hot")
    hot = F.broadcast(hot.select(key, F.lit(True).alias(flag)))
    held = [col(f.name) for f in left.schema if not re.search("map<|variant", f.dataType.simpleString())]
    some = F.pmod(F.xxhash64(*held), F.lit(DEALS)).cast("int")
    many = left.join(hot, key, "left").withColumn(deal, F.when(col(flag), some).otherwise(0)).drop(flag)
    all_ = F.when(col(flag), F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    one = right.join(hot, key, "left").withColumn(deal, F.explode(all_)).drop(flag)
    return many.join(one, [key, deal]).drop(deal)


#: Rows and bytes of an Arrow batch at most, as texts are long and workers hold several copies. A
#: batch ends with the row that goes beyond the bytes, so a longer text is one by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep this session's Arrow batches small; lower settings of its own stay."""
    rows, size = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    number, unit = re.match(r"(-?\d+)\s*([bkmg]?)", spark.conf.get(size, "64m").lower()).groups()
    if not 0 < int(number) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit] <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, named and typed, that may be null."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns.items())])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
