"""Helpers that the operators of this package share: cutting lineage, hot keys, naming."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot if it holds at least this share of the rows, so there are at most 64 hot keys.
HOT_SHARE = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of our own;
    on a cluster that is an error, as a folder of one machine is none of the others'."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: steps are written to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, nothing is computed twice.

    The table is plain Parquet, so a later read needs only the columns it uses and any executor can do it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` as a lambda variable, so that ``value`` is evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key: Column, heavy: dict[object, int], by: Column) -> Column:
    """A salt from 0 to heavy[key] - 1 by the hash ``by``; 0 for keys that aren't hot. ``heavy`` has at most HOT_SHARE keys."""
    if not heavy:
        return F.lit(0)
    n = F.lit(1)
    for k, parts in heavy.items():
        n = F.when(key.eqNullSafe(F.lit(k)), F.lit(parts)).otherwise(n)
    return F.pmod(by, n).cast("int")


def copies(key: Column, heavy: dict[object, int]) -> Column:
    """The salts that a row of the other side of the join must be copied to."""
    n = F.lit(1)
    for k, parts in heavy.items():
        n = F.when(key.eqNullSafe(F.lit(k)), F.lit(parts)).otherwise(n)
    return F.sequence(F.lit(0), n - 1)


def salted(left: DataFrame, right: DataFrame, key: str, heavy: dict, by: Column, how: str = "inner") -> DataFrame:
    """left join right on ``key`` (a column of both, once in the result), the heavy keys dealt out by ``by``."""
    if not heavy:
        return left.join(right, key, how)
    left = left.withColumn("_salt", spread(F.col(key), heavy, by))
    right = right.withColumn("_salt", F.explode(copies(F.col(key), heavy)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, key: str, n: str, parts: int = 64) -> dict[object, int]:
    """Keys with at least 1/HOT_SHARE of all rows (so at most HOT_SHARE), each with a number of parts in proportion.

    ``counts`` holds one row for each key. Only those few keys reach the driver.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < 1000:
        return {}
    least = max(1000, -(-total // HOT_SHARE))
    return {r[0]: max(2, -(-r[1] * parts // total)) for r in counts.where(F.col(n) >= least).select(key, n).collect()}


def fresh(taken: list[str], name: str) -> str:
    """``name``, or the same with underscores before it, so that it is no name in ``taken`` (letter case aside)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
