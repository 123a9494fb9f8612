"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 64-bit hash. A source whose target is k whole passes and a remainder takes all its
documents k times, and those below a hash threshold once more. The threshold is found top down: sum sizes by source
and hash bucket, find the bucket in which the running sum meets the budget, and refine that bucket alone. No sort of
the documents, and the last pass is a filter. Where several rows share the boundary, as repeated rows do, they are told
apart by a second key in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut

BITS, LEVELS = 11, 4
#: Up to so many sources the per-source table (a few numbers each) is broadcast: 100,000 rows of about 100 bytes.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(n: int = 3) -> Column:
    """1, 2, .. n, repeating, over sources by code point with null last (``place`` counts from 0)."""
    return (F.pmod(F.col("place"), F.lit(n)) + 1).cast("double")


def targets(sizes: DataFrame, weight: Column | None = None, cap: float = 3.0) -> DataFrame:
    """source, source_size -> also weight and target.

    The targets share the sum of all sizes by weight; none exceeds ``cap`` times its source's size, and what a capped
    source can't take goes to the others by weight until none is above. That fixed point is: with sources in order of
    size / weight, the first m are capped and the others get weight * (rest / weight of the others) for the least m at
    which the next one fits.
    """
    one = Window.orderBy(F.col("source").isNull(), F.col("source"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = sizes.withColumn("place", F.row_number().over(one) - 1).withColumn("weight", cycling_weights() if weight is None else weight)
    t = t.withColumn("ratio", F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("weight").over(every))
    t = t.withColumn("rest", F.col("total") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("rest") / F.col("rest_w")).withColumn("fits", F.lit(cap) * F.col("ratio") >= F.col("level"))
    t = t.withColumn("level", F.min(F.when(F.col("fits"), F.struct("ratio", "level"))).over(every)["level"])
    full = F.lit(cap) * F.col("source_size")
    return t.withColumn("target", F.least(full.cast("double"), F.coalesce(F.col("weight") * F.col("level"), full.cast("double")))).select("source", "source_size", "weight", "target")


def _hash() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


#: The key of rows that share the first bits of their hash.
_AGAIN = f"(shiftleft(h & {2 ** (64 - BITS * LEVELS) - 1}, {BITS * LEVELS}) | shiftrightunsigned(xxhash64(row), {64 - BITS * LEVELS}))"


def _again() -> Column:
    """What tells rows apart that share the first bits of their hash: its other bits, then a number of the row. Only rows that are equal
    in everything differ in the latter alone, and which of those are taken makes no difference."""
    return F.expr(_AGAIN)


def _top(key: str, level: int) -> Column:
    """The bits of a key above a level's."""
    return F.expr(f"shiftrightunsigned({key}, {64 - BITS * level})") if level else F.lit(0).cast("long")


def _boundary(rows: DataFrame, key: str, state: DataFrame, levels: int, small) -> DataFrame:
    """``state`` (source, left, open, ..) with the prefix of ``key`` at which each open source's budget ``left`` is met, what is
    left before it, and the words and rows that share it."""
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumns({"words": F.lit(None).cast("long"), "rows": F.lit(None).cast("long")})
    kept = [c for c in state.columns if c not in ("left", "prefix", "words", "rows")]
    for level in range(levels):
        bucket = F.expr(f"cast(shiftrightunsigned({key}, {64 - BITS * (level + 1)}) & {2**BITS - 1} as int)")
        of = rows.alias("b").join(small(state.where("open").select(F.col("source").alias("s"), "prefix")), F.col("b.source").eqNullSafe(F.col("s")) & (_top(key, level) == F.col("prefix")))
        sums = of.groupBy("b.source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run)).alias("x").join(small(state.select(F.col("source").alias("s"), "left")), F.col("source").eqNullSafe(F.col("s")))
        # The first bucket whose running sum reaches the budget holds the boundary.
        at = sums.where(F.col("upto") >= F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "rows")).alias("at"))
        state = state.drop("words", "rows").alias("p").join(small(at.select(F.col("source").alias("s"), "at")), F.col("p.source").eqNullSafe(F.col("s")), "left")
        left = F.when(F.col("at").isNotNull(), F.col("left") - (F.col("at.upto") - F.col("at.words"))).otherwise(F.col("left"))
        state = cut(state.select(*[f"p.{c}" for c in kept], left.alias("left"), (F.col("prefix") * 2**BITS + F.coalesce(F.col("at.bucket"), F.lit(2**BITS - 1))).alias("prefix"), F.col("at.words").alias("words"), F.col("at.rows").alias("rows")), "mix-state")
    return state


def _thresholds(docs: DataFrame, size: Column | None, weight: Column | None, cap: int) -> tuple[DataFrame, DataFrame, bool]:
    """Per document: doc_id, source, size, h, row. Per source: s, source_size, target, passes, prefix, second, open, with_last. Whether the latter is small."""
    base = cut(docs.select("doc_id", "source", size.alias("size"), _hash().alias("h"), F.monotonically_increasing_id().alias("row")), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weight, cap)
    n = sizes.count()
    small = (lambda t: F.broadcast(t)) if n <= BROADCAST_SOURCES else (lambda t: t)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("int")
    # Rows below the boundary are in; ``left`` words are still to be taken.
    state = plan.drop("weight").withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("open", F.col("left") > 0)
    state = _boundary(base, "h", cut(state, "mix-state"), LEVELS, small)
    # A prefix that several rows share is searched once more, by what tells these apart.
    state = state.withColumn("deep", F.col("open") & (F.coalesce("rows", F.lit(0)) > 1)).withColumn("second", F.lit(None).cast("long"))
    if not state.where("deep").isEmpty():
        some = small(state.where("deep").select(F.col("source").alias("s"), "prefix"))
        shared = cut(base.join(some, F.col("source").eqNullSafe(F.col("s")) & (_top("h", LEVELS) == F.col("prefix"))).select("source", "size", _again().alias("k")), "mix-shared")
        deep = _boundary(shared, "k", state.where("deep").select("source", "source_size", "target", "passes", "left", "open", "deep", F.col("prefix").alias("first")), LEVELS + 1, small)
        deep = deep.withColumnsRenamed({"prefix": "second", "first": "prefix"})
        state = state.where("NOT deep").unionByName(deep.select(*state.columns))
    # What shares the last prefix goes in if that brings the sum nearer to the budget.
    state = state.withColumn("with_last", F.coalesce(F.col("words") - F.col("left") <= F.col("left"), F.lit(True)))
    state = state.select(F.col("source").alias("s"), "source_size", "target", "passes", "prefix", "second", "open", "with_last")
    return base, cut(state, "mix-state"), n <= BROADCAST_SOURCES


def _taken(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``rows`` (source, h, row, ..) with their source's numbers and ``times``, by a filter on the hash."""
    out = rows.join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("s")))
    top = _top("h", LEVELS)
    out = out.withColumn("k", F.when(F.col("second").isNotNull() & (top == F.col("prefix")), F.expr(f"shiftrightunsigned({_AGAIN}, {64 - BITS * (LEVELS + 1)})")))
    last = F.when(F.col("k").isNull(), F.col("with_last")).otherwise((F.col("k") < F.col("second")) | (F.col("with_last") & (F.col("k") == F.col("second"))))
    more = F.col("open") & ((top < F.col("prefix")) | ((top == F.col("prefix")) & last))
    return out.withColumn("times", F.col("passes") + F.coalesce(more, F.lit(False)).cast("int"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, cap: int = 3) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, times, taken.

    times: how often the mix takes the document (0 to ``cap``); taken = times * size. The words taken from a source
    come within half a document of its target: of the two thresholds around the budget the nearer is used.

    Null text has size 0; null source is a source of its own, the last one. Empty tables give empty results. Of rows that
    repeat an id and a text as many are taken as bring the source nearest to its target; which of them makes no difference.
    Other columns of ``docs`` are ignored. Equal input gives equal output, whatever the partitions.
    """
    out = _taken(*_thresholds(docs, n_words(F.col("text")) if size is None else size, weight, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def apply(docs: DataFrame, size: Column | None = None, weight: Column | None = None, cap: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to ``cap`` times), with all their columns.

    The same decisions as :func:`mix`; taking is a map over the documents, without a shuffle of texts.
    """
    _, state, small = _thresholds(docs, n_words(F.col("text")) if size is None else size, weight, cap)
    rows = docs.select("source", _hash().alias("h"), F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = _taken(rows, state, small).where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
