"""The value at a rank of each group, without sorting or holding a group.

A group's values between the least and the greatest are counted in buckets of equal width, with the least and greatest of each; the
bucket that the rank falls into is looked at again, until all that is left is one value. Counts merge, so a group of any size and with any ties is
spread over all tasks; what a round hands on is a few numbers for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

#: Buckets of a round.
BUCKETS = 1024


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``by`` and ``value``: the value at place ceil(share * n) (at least 1) of the n values of each group in order, ties counted as often as they
    are there. Null and NaN don't count; a group without values has no row. Numbers of any type; the result is one of the values.
    """
    by = by or []
    keys = [f"k{i}" for i in range(len(by))]
    v = F.col(value)
    kind = rows.schema[value].dataType.simpleString()
    given = rows.where(v.isNotNull() if kind not in ("float", "double") else v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v.alias("v"))
    given = cut(given, "values")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    place = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(share) * F.col("n") - 1e-9).cast("long"))
    state = given.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where("n > 0").withColumn("rank", place).drop("n")
    state = cut(state, "ranks")
    done = state.where("lo = hi")
    while not (open_ := state.where("lo < hi")).isEmpty():
        inside = given.alias("g").join(open_.alias("s"), [*same("g", "s"), F.col("g.v").between(F.col("s.lo"), F.col("s.hi"))] if keys else F.col("g.v").between(F.col("s.lo"), F.col("s.hi")))
        found = inside.select(*[F.col(f"g.{k}").alias(k) for k in keys], "v", _bucket(buckets).alias("bucket"), "rank").groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"))
        upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as buckets
        at = found.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("before < rank AND rank <= before + n")
        state = cut(at.select(*keys, "lo", "hi", (F.col("rank") - F.col("before")).alias("rank")), "ranks")
        done = done.unionByName(state.where("lo = hi"))
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("lo").alias(value))


def _bucket(n: int) -> Column:
    """A bucket from 0 to n - 1, which never falls as the value rises."""
    half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  the difference of two numbers may be too large for any, that of their halves isn't
    wide = half("hi") - half("lo")
    # Numbers so near to each other that their halves are equal as doubles differ by little, so their own difference is exact.
    near = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
    part = F.when(wide > 0, (half("v") - half("lo")) / F.when(wide > 0, wide)).otherwise(near)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(part * n))).cast("int")
