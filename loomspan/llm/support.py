"""Small helpers that the operators share: written intermediate tables, partition counts, a filter of keys, let-binding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests) and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-loomspan-"))
    return _OWN_DIR[0]


def scratch(spark: SparkSession) -> str:
    """This application's folder of intermediate tables below the shared one."""
    return f"{shared_dir(spark)}/loomspan-{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. For the end of a job: results still to be computed read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


TASK_BYTES = 1 << 27  # of input to a partition that is dealt by an explicit number


def partitions(df: DataFrame) -> int:
    """Partitions for dealing out ``df`` (a table, or narrow steps over one): the session's number, more if it is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark takes rows that it can't size for endless
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // TASK_BYTES), 1 << 20))


TEXT_ROWS = 1024  # whole texts in one Arrow batch


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold whole texts and go to Python: batches are counted in rows, so the session's
    default of 10,000 would hold gigabytes of long texts at once. Spark reads the setting from the session when
    the query runs, so this lowers it there, to TEXT_ROWS, for what follows too."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


FILTER_BITS = (1 << 20, 1 << 28)  # least and most of the filter below


def may_be_in(keys: DataFrame, col: str) -> Callable:
    """A test that passes every value of ``col`` (a long) and few others: a hashed bit a value, at least 16 bits a value up to
    2**24 values. Beyond, it passes more and stays right. ``keys`` is a written table; the bits are at most 32 MB."""
    least, most = FILTER_BITS
    n_bits = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    place = F.col(col).bitwiseAND(n_bits - 1)
    words = keys.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(n_bits // 64, np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        at = values.to_numpy() & (n_bits - 1)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return test


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, within one row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
