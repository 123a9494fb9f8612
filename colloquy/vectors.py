"""A stored vector index: cells around learned centres, opened from the nearest on, ranked by the exact cosine.

Built once, then kept: ``cells`` holds the vectors in buckets by cell, ``places`` tells the cell of each id, ``centres`` the
centres. Appended vectors go to the cells of the centres that are there; what is deleted is marked. Both are further folders of the
buckets that they touch, and each is a version (:mod:`colloquy.versions`).

A search opens as many cells as held-out vectors needed for ``RECALL`` of their neighbours, then twice as many, until it has what is
asked for or nothing is left. It is called complete only if every vector that it might return was looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, sample
from .versions import Versions, bucket_of, whole, with_folder

#: Vectors that centres are learned from, those with the least hash; vectors of a cell that are aimed at; cells at most.
SAMPLE, CELL, MOST_CELLS = 16_384, 1000, 1024
#: Share of the true neighbours of held-out vectors that the cells opened at first must hold, and how many neighbours.
RECALL, NEIGHBOURS = 0.97, 20
PLACES = 64
ROUNDS, SEED = 12, 17
#: Vectors, and queries, that a task of a search of many queries compares at most; queries of a matrix.
SIDE, STRIP = 16_384, 512


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def learn(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` groups of unit vectors: means on the sphere, each started from a vector far from the others'."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-12
        centres[~empty] = sums[~empty] / norm[~empty, None]
        if empty.any():  # what is farthest from its centre starts a new one
            far = np.argsort((x * centres[own]).sum(axis=1), kind="stable")[: empty.sum()]
            centres[empty] = x[far]
    return centres


def needed(x: np.ndarray, centres: np.ndarray, held: np.ndarray, recall: float = RECALL) -> int:
    """How many cells, from the nearest on, hold ``recall`` of the neighbours of the vectors ``held``."""
    n = min(NEIGHBOURS, len(x) - 1)
    if len(centres) == 1 or n < 1 or not len(held):
        return 1
    s = x[held] @ x.T
    s[np.arange(len(held)), held] = -np.inf
    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
    rank = np.argsort(np.argsort(-(x[held] @ centres.T), axis=1, kind="stable"), axis=1)
    own = (x @ centres.T).argmax(axis=1)
    at = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


@dataclass
class Found:
    """``complete``: every eligible vector was examined. ``examined``: how many were; ``opened``: of how many cells."""

    hits: DataFrame
    complete: bool
    examined: int
    opened: int


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class VectorIndex:
    """The index at a path, as of its latest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Versions(spark, path)

    # --- writing

    @staticmethod
    def _valid(vectors: DataFrame, dim: int | None = None) -> DataFrame:
        """id, v, norm, and what else the rows have (kept as a struct, more): vectors of finite components, not all zero."""
        v = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.struct(F.lit(0).alias("_"), *[c for c in vectors.columns if c not in ("id", "embedding")]).alias("more"))
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        v = v.where(F.col("id").isNotNull() & (F.size("v") > 0) & good).withColumn("norm", F.sqrt(dot("v", "v"))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
        return v if dim is None else v.where(F.size("v") == dim)

    @staticmethod
    def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """``rows`` with their cell."""

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": b.column("v"), "norm": b.column("norm"), "more": b.column("more"), "cell": pa.array((x @ centres.T).argmax(axis=1), pa.int32())})

        return rows.mapInArrow(nearest, rows.select("id", "v", "norm", "more", F.lit(0).alias("cell")).schema)

    @classmethod
    def build(cls, spark: SparkSession, path: str, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """A new version of nothing but ``vectors`` (id, embedding, and columns to give back with the hits). Those of another length
        than most have no place in it, nor have zero vectors."""
        self = cls(spark, path)
        base = self.log.manifest()
        all_ = cut(cls._valid(vectors), "vectors")
        size = all_.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim, n = (size["d"], size["count"]) if size else (0, 0)
        rows = all_.where(F.size("v") == dim)
        few = [r["v"] for r in sample(rows.select("id", "v"), "id", SAMPLE, n)]
        x = units(np.array(few)) if few else np.empty((0, dim))
        n_cells = max(1, min(MOST_CELLS, -(-n // CELL) if cells is None else cells, max(1, len(x) // 16)))
        centres = learn(x, n_cells) if len(x) else np.empty((0, dim))
        held = np.arange(0, len(x), max(1, len(x) // 512))
        facts = {"dim": dim, "n": n, "probes": needed(x, centres, held) if len(x) else 1, "cells": len(centres), "batches": {}}
        tables = {}
        if len(x):
            mine = cut(cls._assigned(rows, centres).withColumn("stamp", F.lit(base["version"] + 1).cast("long")).withColumn("gone", F.lit(False)), "assigned")
            # A cell that holds very many is dealt to several tasks and files.
            placed = mine.withColumn("bucket", F.col("cell")).repartitionByRange("bucket", F.xxhash64("id")).sortWithinPartitions("bucket")
            kept = mine.select(bucket_of(["id"], PLACES).alias("bucket"), "id", "cell", "stamp", "gone").repartition("bucket")
            points = spark.createDataFrame([(0, i, [float(v) for v in c]) for i, c in enumerate(centres)], "bucket int, cell int, centre array<double>").coalesce(1)
            tables = {name: whole(df, *self.log.stage(df)) for name, df in (("cells", placed), ("places", kept), ("centres", points))}
        self.log.commit(base, tables, facts)
        return self

    def _centres(self, manifest: dict) -> np.ndarray:
        rows = sorted(self.log.read(manifest, "centres").collect(), key=lambda r: r["cell"])  # MOST_CELLS at most
        return np.array([r["centre"] for r in rows])

    def _places(self, manifest: dict, ids: DataFrame) -> DataFrame:
        """id, cell of those of ``ids`` that the index holds."""
        keyed = ids.select(F.col("id").cast("long").alias("id")).distinct().withColumn("b", bucket_of(["id"], PLACES))
        touched = [r["b"] for r in keyed.select("b").distinct().collect()]
        stored = self.log.read(manifest, "places", touched).join(keyed.select("id"), "id", "left_semi")
        return stored.groupBy("id").agg(F.max_by(F.struct("cell", "gone"), F.struct("stamp", ~F.col("gone"))).alias("r")).where("NOT r.gone").select("id", "r.cell")

    def _change(self, new: DataFrame | None, ids: DataFrame) -> int:
        """Marks for those of ``ids`` that are there, then ``new``, in one version."""
        base = self.log.manifest()
        if not base["tables"]:
            raise ValueError("there is no index yet")
        stamp = base["version"] + 1
        old = cut(self._places(base, ids), "old")
        like = self.log.read(base, "cells").limit(0)
        n_old, n_new = old.count(), 0
        marks = old.withColumns({"stamp": F.lit(stamp).cast("long"), "gone": F.lit(True)})
        cells = marks.select("id", *[F.lit(None).cast(like.schema[c].dataType).alias(c) for c in ("v", "norm", "more")], "cell", "stamp", "gone")
        places = marks.select("id", "cell", "stamp", "gone")
        if new is not None:
            mine = cut(self._assigned(self._valid(new, base["facts"]["dim"]), self._centres(base)), "appended").withColumns({"stamp": F.lit(stamp).cast("long"), "gone": F.lit(False)})
            n_new = mine.count()
            cells = cells.unionByName(mine)
            places = places.unionByName(mine.select("id", "cell", "stamp", "gone"))
        tables = dict(base["tables"])
        for name, df in (("cells", cells.withColumn("bucket", F.col("cell"))), ("places", places.withColumn("bucket", bucket_of(["id"], PLACES)))):
            tables[name] = with_folder(tables[name], *self.log.stage(df.repartition("bucket")), instead=False)
        return self.log.commit(base, tables, base["facts"] | {"n": base["facts"]["n"] + n_new - n_old})["version"]

    def append(self, vectors: DataFrame) -> int:
        """``vectors`` as well; one with an id that is there takes its place."""
        return self._change(vectors, vectors.select("id"))

    def delete(self, ids: DataFrame) -> int:
        """Without these ids (id)."""
        return self._change(None, ids)

    # --- reading

    def _members(self, manifest: dict, cells: list[int]) -> DataFrame:
        """id, cell, v, norm, more of the vectors of some cells: only their folders are opened."""
        rows = self.log.read(manifest, "cells", cells)
        parts = manifest["tables"]["cells"]["parts"]
        if all(len(parts.get(str(c), [])) <= 1 for c in cells):
            return rows.where("NOT gone").select("id", "cell", "v", "norm", "more")
        # What a version marks as gone may come again in the same version.
        return rows.groupBy("id", "cell").agg(F.max_by(F.struct("v", "norm", "more", "gone"), F.struct("stamp", ~F.col("gone"))).alias("r")).where("NOT r.gone").select("id", "cell", "r.v", "r.norm", "r.more")

    def search(self, vector: list[float], limit: int, eligible: DataFrame | None = None, most: float | None = None, widest: int | None = None) -> Found:
        """The nearest to ``vector``: place, id, cosine and the kept columns. Only ids in ``eligible`` (id), if given; only distances (1 - cosine)
        of at most ``most``. Cells are opened until there are ``limit`` hits, at most ``widest`` of them if that is given."""
        manifest = self.log.manifest()
        facts, q = manifest["facts"], np.array(vector, dtype=np.float64)
        empty = self.spark.createDataFrame([], "place int, id long, cosine double")
        if not manifest["tables"] or len(q) != facts["dim"] or not np.any(q):
            return Found(empty, True, 0, 0)
        parts = manifest["tables"]["cells"]["parts"]
        order = [int(c) for c in np.argsort(-(self._centres(manifest) @ q), kind="stable") if str(int(c)) in parts]
        ask = F.lit([float(x) for x in q])
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("v", ask) / (F.col("norm") * float(np.linalg.norm(q)))))
        n = min(len(order), facts["probes"])
        last = len(order) if widest is None else min(len(order), widest)
        while True:
            n = min(n, last)
            inside = self._members(manifest, order[:n])
            if eligible is not None:
                inside = inside.join(eligible.select("id"), "id", "left_semi")
            scored = cut(inside.select("id", cosine.alias("cosine"), "more"), "opened")
            near = scored if most is None else scored.where(1 - F.col("cosine") <= most)
            found = near.count()
            if found >= limit or n >= last:
                break
            n *= 2
        best = Window.orderBy(F.desc(F.round("cosine", 9)), "id")
        top = near.orderBy(F.desc(F.round("cosine", 9)), "id").limit(limit)
        hits = top.withColumn("place", F.row_number().over(best)).select("place", "id", "cosine", "more.*").drop("_")
        return Found(hits, n >= len(order), scored.count(), n)

    def search_all(self, queries: DataFrame, limit: int, probes: int | None = None, side: int = SIDE) -> DataFrame:
        """query_id, rank, id, cosine for each of ``queries`` (query_id, embedding): the nearest in the cells that are opened for it,
        ties to the smaller id. Cells lie in groups of about ``side`` vectors, a cell that is larger in several; a query goes once to each
        group that has a cell of its, whatever their number, and takes its ``limit`` nearest from each."""
        manifest = self.log.manifest()
        facts, centres = manifest["facts"], self._centres(manifest)
        n, dim = min(facts["cells"], probes or facts["probes"]), facts["dim"]
        valid = cut(self._valid(queries.select(F.col("query_id").alias("id"), "embedding"), dim).select("id", "v", "norm"), "asked")
        members = self._members(manifest, [int(c) for c in manifest["tables"]["cells"]["parts"]])
        sizes = {r["cell"]: r["count"] for r in members.groupBy("cell").count().collect()}  # MOST_CELLS at most
        # As many groups as keep all cores busy, if they are few.
        side = max(1, min(side, max(256, sum(sizes.values()) // (4 * self.spark.sparkContext.defaultParallelism))))
        first, parts, filled, group = np.full(len(centres), -1), np.zeros(len(centres), dtype=np.int64), 0, 0
        for c in sorted(sizes):
            if filled and filled + sizes[c] > side:
                filled, group = 0, group + 1
            first[c], parts[c] = group, -(-sizes[c] // side)
            if parts[c] > 1:
                filled, group = 0, group + int(parts[c])
            else:
                filled += sizes[c]
        shares = max(1, -(-valid.count() // SIDE))  # of the queries

        def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
                at, cells = np.repeat(np.arange(len(b)), n), cells.ravel()
                times = parts[cells]
                at, cells = np.repeat(at, times), np.repeat(cells, times)
                to = first[cells] + np.arange(len(cells)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((cells, to, at))
                at, cells, to = at[order], cells[order], to[order]
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (to[1:] != to[:-1])]) if len(at) else np.empty(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(cells)], pa.int32()), pa.array(cells, pa.int32()))
                rows = pa.array(at[new])
                yield pa.RecordBatch.from_pydict({"query_id": b.column("id").take(rows), "q": b.column("v").take(rows), "q_norm": b.column("norm").take(rows), "opened": lists, "to": pa.array(to[new], pa.int32())})

        def nearest(asked: pa.Table, held: pa.Table) -> pa.Table:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if len(asked) and len(held):
                numbers = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False)
                x, y = (numbers(t.column(c)).reshape(-1, dim) for t, c in ((asked, "q"), (held, "v")))
                x_norm, y_norm, ask, ids = (t.column(c).to_numpy() for t, c in ((asked, "q_norm"), (held, "norm"), (asked, "query_id"), (held, "id")))
                opened = asked.column("opened").to_pylist()
                of: dict[int, list[int]] = {}
                for i, cells in enumerate(opened):
                    for c in cells:
                        of.setdefault(c, []).append(i)
                cell = held.column("cell").to_numpy()
                mine = [(np.flatnonzero(cell == c), np.array(rows)) for c, rows in of.items()]
                for at in range(0, len(asked), STRIP):
                    cosine = np.full((min(STRIP, len(asked) - at), len(held)), -np.inf)
                    for columns, rows in mine:
                        rows = rows[(rows >= at) & (rows < at + STRIP)]
                        if len(rows) and len(columns):
                            cosine[np.ix_(rows - at, columns)] = (x[rows] @ y[columns].T) / (x_norm[rows, None] * y_norm[None, columns])
                    np.clip(cosine, -np.inf, 1.0, out=cosine)
                    least = np.partition(cosine, len(held) - limit, axis=1)[:, len(held) - limit] if len(held) > limit else np.full(len(cosine), -np.inf)
                    i, j = np.nonzero((cosine >= least[:, None] - 2e-9) & (cosine > -np.inf))  # with all that nine places don't tell apart
                    found.append((ask[i + at], ids[j], np.maximum(cosine[i, j], -1.0)))
            return pa.table(dict(zip(("query_id", "id", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        asked = valid.mapInArrow(open_, "query_id long, q array<double>, q_norm double, opened array<int>, to int").withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)))
        place = F.create_map(*[F.lit(int(x)) for c in sorted(sizes) for x in (c, first[c])])[F.col("cell")] if sizes else F.lit(0)
        part = F.create_map(*[F.lit(int(x)) for c in sorted(sizes) for x in (c, parts[c])])[F.col("cell")] if sizes else F.lit(1)
        dealt = members.select("id", "cell", "v", "norm", (place + F.pmod(F.xxhash64("id"), part)).cast("int").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
        met = asked.groupBy("to", "share").cogroup(dealt.groupBy("to", "share")).applyInArrow(nearest, "query_id long, id long, cosine double")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "cosine")
