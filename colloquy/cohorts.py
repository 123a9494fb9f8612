"""What voices have with the others of their library, by matrices of bounded size.

The voices of a library are dealt to parts of at most ``side`` rows; a unit is two parts of one library, or one with itself, so every pair
is met in one unit, whatever the size of a library. Means and deviations are sums over units; a pair is no row before it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Rows of a unit's side where a unit gives sums, and where it gives pairs; rows of a matrix.
SIDE, PAIRED, STRIP = 8192, 2048, 512

SUMS = "vec_id long, n long, s double, ss double"


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v")
        at, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        x = [values[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in ("vec_id", "library_id", "recording_id")}, "x": pa.array(x, pa.binary())})


def packed(voices: DataFrame) -> DataFrame:
    """vec_id, library_id, recording_id, x of ``voices`` (vec_id, library_id, recording_id, embedding), written down. A vector that is null or holds
    a null is empty: its cosines are 0."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = voices.where("vec_id IS NOT NULL AND library_id IS NOT NULL AND recording_id IS NOT NULL")
    rows = rows.select(*[F.col(c).cast("long").alias(c) for c in ("vec_id", "library_id", "recording_id")], F.when(whole, v).otherwise(F.array().cast("array<double>")).alias("v"))
    return cut(rows.mapInArrow(_flat, "vec_id long, library_id long, recording_id long, x binary"), "packed")


class _Side:
    """One side of a unit: vectors by their length, norms."""

    def __init__(self, x: pa.ChunkedArray):
        raw = x.to_pylist()
        dims = np.array([len(r) // 8 for r in raw], dtype=np.int64)
        self.norm, self.of = np.zeros(len(raw)), {}
        for d in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == d)
            v = np.frombuffer(b"".join(raw[i] for i in at), dtype=np.float64).reshape(-1, d)
            self.norm[at] = np.sqrt((v * v).sum(axis=1))
            self.of[int(d)] = (at, v)

    def cosines(self, rows: slice, other: _Side) -> np.ndarray:
        """Cosines of some rows and all of the other side's; 0 if the lengths differ, there are none, or a norm is zero."""
        n = len(self.norm[rows])
        c = np.zeros((n, len(other.norm)))
        for d, (at, v) in self.of.items():
            if d in other.of:
                mine = (at >= rows.start) & (at < rows.stop)
                c[np.ix_(at[mine] - rows.start, other.of[d][0])] = v[mine] @ other.of[d][1].T
        norms = self.norm[rows, None] * other.norm[None, :]
        with np.errstate(all="ignore"):
            return np.where(norms <= 0, 0.0, c / norms)


def _units(rows: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Rows on the left and on the right of each unit (library_id, i, j), i <= j; a part with itself has no right."""
    n = rows.groupBy("library_id").agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    dealt = rows.join(n, "library_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    left = dealt.withColumn("j", F.explode(F.sequence("part", F.col("parts") - 1))).withColumnRenamed("part", "i")
    right = dealt.where("part > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).withColumnRenamed("part", "j")
    return tuple(x.select("library_id", "i", "j", *[c for c in rows.columns if c != "library_id"]) for x in (left, right))


def _over(rows: DataFrame, side: int, unit: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    left, right = _units(rows, side)
    key, names = ["library_id", "i", "j"], right.columns
    right = right.select(*[F.col(c).alias(f"{c}_") for c in names])

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        return unit(a, b.rename_columns(names) if len(b) else None)

    return left.groupBy(*key).cogroup(right.groupBy(*[f"{c}_" for c in key])).applyInArrow(one, schema)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _strips(a: pa.Table, b: pa.Table | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of the left, their cosines with the right (or the left itself), and which of them are of different recordings."""
    x = _Side(a.column("x"))
    y = x if b is None else _Side(b.column("x"))
    of_a, of_b = _column(a, "recording_id"), _column(a if b is None else b, "recording_id")
    for at in range(0, len(a), STRIP):
        rows = slice(at, min(at + STRIP, len(a)))
        yield rows, x.cosines(rows, y), of_a[rows, None] != of_b[None, :]


def _sums(rows: DataFrame, side: int, banded: bool) -> DataFrame:
    """vec_id, n, m, s: number, mean and deviation of the cosines of each voice; of those within lo and hi, if ``banded``."""

    def unit(a: pa.Table, b: pa.Table | None) -> pa.Table:
        sides = [a] if b is None else [a, b]
        total = [np.zeros((3, len(t))) for t in sides]
        lo, hi = ([_column(t, c) for t in sides] for c in ("lo", "hi")) if banded else (None, None)

        def add(k: int, at: slice, c: np.ndarray, keep: np.ndarray, axis: int) -> None:
            if banded:  # as in SQL, NaN is greater than any number and equal to itself
                low, high = (np.expand_dims(x[k][at], axis) for x in (lo, hi))
                keep = keep & ((c >= low) | np.isnan(c)) & ((c <= high) | np.isnan(high))
            kept = np.where(keep, c, 0.0)
            total[k][0, at] += keep.sum(axis=axis)
            total[k][1, at] += kept.sum(axis=axis)
            total[k][2, at] += (kept * kept).sum(axis=axis)

        for at, c, apart in _strips(a, b):
            add(0, at, c, apart, 1)
            if b is not None:
                add(1, slice(0, len(b)), c, apart, 0)
        n, s, ss = np.concatenate(total, axis=1)
        return pa.table({"vec_id": np.concatenate([_column(t, "vec_id") for t in sides]), "n": n.astype(np.int64), "s": s, "ss": ss})

    t = _over(rows, side, unit, SUMS).groupBy("vec_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).where("n > 0")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    return t.select("vec_id", "n", (F.col("s") / F.col("n")).alias("m"), F.when(F.col("n") > 1, F.greatest(F.lit(0.025), spread)).otherwise(1.0).alias("s"))


def deviations(rows: DataFrame, side: int = SIDE) -> DataFrame:
    """``rows`` (:func:`packed`) of voices that have any pair, with m and s: mean and deviation of their cosines with voices of other recordings of
    the library; a second look leaves out what is two deviations off, if three are left."""
    one = cut(_sums(rows, side, False), "first_look")
    band = one.select("vec_id", (F.col("m") - 2 * F.col("s")).alias("lo"), (F.col("m") + 2 * F.col("s")).alias("hi"))
    # Voices without a first look have no pairs, and are in nobody's.
    two = _sums(rows.join(band, "vec_id"), side, True).where("n >= 3").select("vec_id", F.col("m").alias("m2"), F.col("s").alias("s2"))
    st = one.join(two, "vec_id", "left").select("vec_id", F.coalesce("m2", "m").alias("m"), F.coalesce("s2", "s").alias("s"))
    return cut(rows.join(st, "vec_id"), "deviations")


def z_score(c, m, s, other_m, other_s):
    """The mean of both z-scores, held within 6."""
    z = ((c - m) / s + (c - other_m) / other_s) / 2
    return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))


def pairs(rows: DataFrame, side: int = PAIRED) -> DataFrame:
    """a, b, c, z of all pairs of different recordings of a library, a < b: ``rows`` as :func:`deviations` gives them."""

    def unit(x: pa.Table, y: pa.Table | None) -> pa.Table:
        right = x if y is None else y
        ids, of = _column(x, "vec_id"), _column(right, "vec_id")
        (m, s), (m_, s_) = ([_column(t, c) for c in ("m", "s")] for t in (x, right))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        for at, c, apart in _strips(x, y):
            if y is None:
                apart &= ids[at, None] < of[None, :]
            i, j = np.nonzero(apart)
            c, i = c[i, j], i + at.start
            with np.errstate(all="ignore"):
                z = ((c - m[i]) / s[i] + (c - m_[j]) / s_[j]) / 2
            out.append((np.minimum(ids[i], of[j]), np.maximum(ids[i], of[j]), c, np.fmax(-6.0, np.fmin(6.0, z))))
        return pa.table(dict(zip(("a", "b", "c", "z"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return _over(rows, side, unit, "a long, b long, c double, z double")
