"""All pairs of vectors that are similar enough, without comparing all pairs.

Angles between unit vectors are distances, so a pair within the angle t is, seen from any pivot, within t too. Rows lie in blocks:
the nearest pivot, and a ring around it. A block knows the least and greatest angle of its rows to every pivot. A row meets the rows of its
own block, and another block only if no pivot rules out a partner there. Each pair is met once, in the block with the larger
number. Blocks lie in groups of bounded size; a row goes once to each group that has a block for it, and meets those blocks alone. Groups and
their visitors are dealt to units of bounded size; equal vectors are one until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, sample

#: Vectors that pivots are chosen from, those with the least hash; pivots; rows of a unit's side.
SAMPLE, PIVOTS, CHUNK = 4096, 64, 16_384
#: Rows that are looked at together: of angles to the bounds of blocks, and of a matrix of cosines.
ROWS, STRIP = 128, 512
#: Slack for rounding, in radians of the brackets; and of the cosine, below which pairs are looked at exactly.
SLACK = 1e-7


def chosen(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the unit vectors ``x``, each the farthest from those before."""
    out, near = [x[0]], x @ x[0]
    while len(out) < min(n, len(x)):
        out.append(x[int(near.argmin())])
        near = np.maximum(near, x @ out[-1])
    return np.array(out)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def doubles(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def dealt(ids: np.ndarray, among: np.ndarray, by: int) -> np.ndarray:
    """Each id's place among as many, by a hash."""
    return ((ids.astype(np.uint64) * np.uint64(by)) >> np.uint64(33)).astype(np.int64) % among


class Pairs:
    """The pairs of ``vectors`` (id, embedding) with a cosine of at least ``least`` (above 0): :meth:`found` and, for what it took, :meth:`met`.

    Null, zero and non-finite vectors have no pairs; vectors of another length than most neither. Ids are taken to be
    unique. Equal vectors are compared as one; :meth:`found` lists all pairs of their ids, as it has to.
    """

    def __init__(self, vectors: DataFrame, least: float, pivots: int = PIVOTS, chunk: int = CHUNK):
        if not 0 < least <= 1:
            raise ValueError("least must be above 0 and at most 1")
        self.least, self.chunk = least, chunk
        turn = math.acos(least)
        v = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        v = v.where(F.col("id").isNotNull() & (F.size("v") > 0) & good)
        size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.dim = dim = size["d"] if size else 0

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) + 0.0
                    x = x / np.abs(x).max(axis=1)[:, None]  # lengths of any size
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    yield pa.RecordBatch.from_pydict({"id": b.column("id"), "x": [r.tobytes() for r in x]})

        rows = v.where(F.size("v") == dim).mapInArrow(pack, "id long, x binary")
        self.members = cut(rows.withColumn("key", F.md5("x")), "members")
        distinct = cut(self.members.groupBy("key").agg(F.first("x").alias("x"), F.min("id").alias("id"), F.count("*").alias("n")).select("id", "key", "x", "n"), "distinct")
        total = distinct.count()
        few = sample(distinct.select("key", "x"), "key", SAMPLE, total)
        self._spark = vectors.sparkSession
        if not few:
            self.units = None
            return
        points = chosen(np.frombuffer(b"".join(r["x"] for r in few), dtype=np.float64).reshape(-1, dim), max(1, min(pivots, len(few) // 4)))
        ring = max(turn / 2, 0.02)
        rings = int(math.pi / ring) + 1

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    a = angles(doubles(b.column("x"), dim), points)
                    cell = a.argmin(axis=1)
                    block = cell * rings + (a[np.arange(len(a)), cell] / ring).astype(int)
                    yield pa.RecordBatch.from_pydict({"id": b.column("id"), "x": b.column("x"), "block": pa.array(block, pa.int32())})

        placed = cut(distinct.select("id", "x").mapInArrow(place, "id long, x binary, block int"), "placed")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block, a = b.column("block").to_numpy(), angles(doubles(b.column("x"), dim), points)
                for k in np.unique(block):
                    mine = a[block == k]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k] * len(points), pa.int32()), "j": pa.array(range(len(points)), pa.int32()), "lo": mine.min(axis=0), "hi": mine.max(axis=0), "n": pa.array([len(mine)] * len(points), pa.int64())})

        # As many blocks as pivots and rings, so this table is of bounded size.
        table = placed.mapInArrow(bounds, "block int, j int, lo double, hi double, n long").groupBy("block", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
        ids = np.array(sorted({r["block"] for r in table}))
        at = {b: i for i, b in enumerate(ids)}
        lo, hi = np.zeros((len(ids), len(points))), np.zeros((len(ids), len(points)))
        held = np.zeros(len(ids), dtype=np.int64)
        for r in table:
            lo[at[r["block"]], r["j"]], hi[at[r["block"]], r["j"]], held[at[r["block"]]] = r["lo"], r["hi"], r["n"]

        # Which of the blocks (as places in ids) rows may have a partner in: their own, and later ones that no pivot rules out.
        def meets(home: np.ndarray, a: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            among = np.arange(len(ids)) if among is None else among
            for k in np.unique(home):
                mine, i = np.flatnonzero(home == k), at[k]
                own, later = among[among == i], among[among > i]
                # Blocks that a whole block can't reach first, then row by row.
                later = later[np.maximum(lo[later] - hi[i], lo[i] - hi[later]).max(axis=1) <= turn + SLACK]
                for s in range(0, len(mine), ROWS):
                    part = mine[s : s + ROWS]
                    go = np.ones((len(part), len(later)), dtype=bool)
                    for p in range(len(points)):  # pivot by pivot, so that nothing is larger than rows by blocks
                        x = a[part, p, None]
                        go &= (lo[later, p] - x <= turn + SLACK) & (x - hi[later, p] <= turn + SLACK)
                    r, c = np.nonzero(go)
                    yield np.r_[np.repeat(part, len(own)), part[r]], np.r_[np.full(len(part) * len(own), i), later[c]]

        # As many groups as keep all cores busy, if they are few; a block that is larger is a group of its own.
        side = max(1, min(chunk, max(512, total // (2 * self._spark.sparkContext.defaultParallelism))))
        group, filled = np.zeros(len(ids), dtype=np.int64), 0
        for i in range(1, len(ids)):
            filled += held[i - 1]
            group[i] = group[i - 1] + (filled + held[i] > side)
            filled = 0 if group[i] > group[i - 1] else filled
        sizes = np.bincount(group, weights=held).astype(np.int64)
        parts = -(-sizes // side)  # of each group, on the side of its own rows

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = b.column("block").to_numpy()
                for r, t in meets(home, angles(doubles(b.column("x"), dim), points)):
                    r, g = np.unique(np.column_stack([r, group[t]]), axis=0).T
                    r = pa.array(r)
                    yield pa.RecordBatch.from_pydict({"id": b.column("id").take(r), "x": b.column("x").take(r), "block": b.column("block").take(r), "group": pa.array(g, pa.int32())})

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = b.column("block").to_numpy()
                seen, pairs = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
                for r, t in meets(home, angles(doubles(b.column("x"), dim), points)):
                    np.add.at(pairs, group[t], np.where(ids[t] == home[r], 0, held[t]))
                    np.add.at(seen, np.unique(np.column_stack([r, group[t]]), axis=0)[:, 1], 1)
                yield pa.RecordBatch.from_pydict({"group": pa.array(np.arange(len(sizes)), pa.int32()), "n": seen, "pairs": pairs})

        # A row for each group. Rows are looked at again when they visit, which is less than to write them down.
        counted = {r["group"]: r for r in placed.mapInArrow(visits, "group int, n long, pairs long").groupBy("group").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).collect()}
        self._met = sum(r["pairs"] for r in counted.values()) + int((held * (held - 1) // 2).sum())
        shares = np.array([max(1, -(-counted[g]["n"] // side)) for g in range(len(sizes))])

        def host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g = group[[at[k] for k in b.column("block").to_numpy()]]
                r = np.repeat(np.arange(len(b)), shares[g])
                j = np.arange(len(r)) - np.repeat(np.cumsum(shares[g]) - shares[g], shares[g])
                i = dealt(b.column("id").to_numpy(), parts[g], 0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_pydict({**{c: b.column(c).take(pa.array(r)) for c in ("id", "x", "block")}, "group": pa.array(g[r], pa.int32()), "i": pa.array(i[r], pa.int32()), "j": pa.array(j, pa.int32())})

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in visit(batches):
                g = b.column("group").to_numpy()
                r = np.repeat(np.arange(len(b)), parts[g])
                i = np.arange(len(r)) - np.repeat(np.cumsum(parts[g]) - parts[g], parts[g])
                j = dealt(b.column("id").to_numpy(), shares[g], 0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_pydict({**{c: b.column(c).take(pa.array(r)) for c in ("id", "x", "block", "group")}, "i": pa.array(i, pa.int32()), "j": pa.array(j[r], pa.int32())})

        schema = "id long, x binary, block int, group int, i int, j int"
        right = placed.mapInArrow(deal, schema)
        self.units = (placed.mapInArrow(host, schema), right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]))
        self._meets, self._at = meets, at
        self._points = points

    def met(self) -> int:
        """How many pairs are compared."""
        return 0 if self.units is None else self._met

    def between_classes(self) -> DataFrame:
        """a, b, cosine: pairs of different vectors, each named by the least of its ids; a < b."""
        if self.units is None:
            return self._spark.createDataFrame([], "a long, b long, cosine double")
        least, dim, meets, at, points = self.least, self.dim, self._meets, self._at, self._points
        coarse = least - 1e-9 - (dim + 2) * 1.2e-7  # what single precision may be off by

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if len(left) and len(right):
                x, y, p, q = doubles(left.column("x"), dim), doubles(right.column("x_"), dim), left.column("id").to_numpy(), right.column("id_").to_numpy()
                small, small_y = x.astype(np.float32), y.astype(np.float32)
                lies, home = (np.array([at[k] for k in t.column(c).to_pylist()]) for t, c in ((left, "block"), (right, "block_")))
                here = {i: np.flatnonzero(lies == i) for i in np.unique(lies)}
                met = list(meets(right.column("block_").to_numpy(), angles(y, points), np.array(sorted(here))))
                rows, blocks = (np.concatenate([m[k] for m in met]) for k in (0, 1))
                for i, mine in here.items():
                    guests = rows[blocks == i]
                    for s in range(0, len(guests), STRIP):
                        g = guests[s : s + STRIP]
                        c, r = np.nonzero(small_y[g] @ small[mine].T >= coarse)
                        c, r = g[c], mine[r]
                        once = (home[c] != i) | (p[r] < q[c])  # in its own block each pair comes twice
                        c, r = c[once], r[once]
                        cosine = np.minimum(1.0, (x[r] * y[c]).sum(axis=1))
                        keep = cosine >= least - 1e-12
                        r, c, cosine = r[keep], c[keep], cosine[keep]
                        found.append((np.minimum(p[r], q[c]), np.maximum(p[r], q[c]), cosine))
            return pa.table(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        key = ["group", "i", "j"]
        return self.units[0].groupBy(*key).cogroup(self.units[1].groupBy(*[f"{c}_" for c in key])).applyInArrow(compare, "a long, b long, cosine double")

    def found(self) -> DataFrame:
        """a, b, cosine of all pairs of ids, a < b."""
        if self.units is None:
            return self.between_classes()
        names = self.members.groupBy("key").agg(F.min("id").alias("class"), F.count("*").alias("n"))
        several = self.members.join(names.where("n > 1"), "key").select("class", "id")
        equal = several.select("class", F.col("id").alias("a")).join(several.select("class", F.col("id").alias("b")), "class").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
        classes = self.members.join(names, "key").select("class", "id")
        other = self.between_classes().join(classes.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(classes.select(F.col("class").alias("b"), F.col("id").alias("y")), "b")
        return other.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine").unionByName(equal)
