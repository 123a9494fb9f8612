"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and the master is local; elsewhere an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: steps are written to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, wherever Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` down and read it back: lineage ends, nothing is computed twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample(rows: DataFrame, key: str, n: int, total: int) -> list[Row]:
    """The ``n`` of ``total`` rows with the least hash of ``key``, at the driver. A limit alone would have each task send ``n`` rows: only rows under
    a bound on the hash are sorted, which leaves not many more than ``n`` in all."""
    hashed = F.xxhash64(key)
    share = (1.2 * n + 1000) / max(1, total)
    few: list[Row] = []
    if share < 1:
        few = rows.where(hashed <= min(2**63 - 1, int(-(2**63) + share * 2**64))).orderBy(hashed, key).limit(n).collect()
    # Of keys that come often the bound may leave too few.
    return few if len(few) >= min(n, total) else rows.orderBy(hashed, key).limit(n).collect()
