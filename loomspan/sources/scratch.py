"""A shared folder for intermediate tables and stream checkpoints; how many parts large tables are dealt to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
PART_BYTES = 1 << 22  # of the (compressed) tables that rows come from, to one task that sorts them
MOST_PARTS = 1 << 16
FINE_PARTS = 2000  # of one shuffle, up to which Spark knows the size of each block; a table that is read many times for a plan of many shuffles is counted as often


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir, which the cluster shares. Where that is unset, a temporary folder in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-loomspan-"))
        base = _OWN[0]
    return f"{base}/{what}-{uuid.uuid4().hex}"


def parts(df: DataFrame) -> int:
    """How many tasks are to sort ``df``, so that the memory of one does not grow with the table: by the sizes of the tables that it reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # Spark takes rows that it can't size for endless
    return max(1, min(-(-known // PART_BYTES), MOST_PARTS))


def dealt(df: DataFrame, *keys: str, n: int = 0) -> DataFrame:
    """``df`` dealt out by ``keys`` to the session's number of partitions, which Spark may join, or to more if it is large: ``n``, or as its size asks for.

    Tables that are dealt by the same keys to the same ``n`` are joined where they lie.
    """
    n = n or parts(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


# While a table is written: shuffle files go when it is there, as nothing reads them again; and tables that were dealt out by a part of
# a join's keys (by file, say, before files and blocks of lines) are joined where they lie.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def written(df: DataFrame, what: str, *by: str, shuffle_parts: int = 1) -> DataFrame:
    """Write a table to the shared folder, in folders by the columns ``by``, and read it back: later steps read it instead of making it again.

    Shuffles of the write have ``shuffle_parts`` partitions (``FINE_PARTS`` at most), if the session's number is less: for windows, which take that number. Their
    files are removed after the write, so the disk holds those of one step at a time.
    """
    spark, path, key = df.sparkSession, scratch(df.sparkSession, what), "spark.sql.shuffle.partitions"
    session = {key: spark.conf.get(key)} | {k: spark.conf.get(k, None) for k in _LEAN}
    try:
        for k, v in _LEAN.items():
            spark.conf.set(k, v)
        if (n := min(shuffle_parts, FINE_PARTS)) > int(session[key]):
            spark.conf.set(key, str(n))
        df.write.partitionBy(*by).parquet(path)
    finally:
        for k, v in session.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
