"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: build the neighbour graph of the sample, cut it into balanced parts by recursive bisection,
and train a softmax classifier that predicts in which parts a vector's neighbours lie. Parts that are still large are
fitted and cut again, each on a sample of its own, so that the number of parts grows with the data: a tree of routers.
Index: every vector goes down the tree to its most probable part. Search: a query goes down to the several most probable
parts of each router that it meets, and what those hold is ranked by exact inner product.

Equal vectors are one class, with its 21 smallest ids: a vector that a third of the rows share costs as much as any.
A part meets only the queries that are routed to it. A large part is dealt to blocks of bounded size, and the
queries of a part to chunks of bounded size, so no task sees more than a block and a chunk. Where these are large, the task itself cuts
its block by a router of its own: a query is copied for each part and block that it meets, so further levels that are shuffled would cost
as many copies as they have parts opened. Vectors are kept in the width in which they are given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._common import cut, hot_keys, salted

#: Vectors that one router is fitted on, about: those with the least hash.
SAMPLE = 8192
#: Distinct vectors of a part that are aimed at. A part of more than twice as many is cut again.
LEAF = 256
#: Parts of one router, at most (the sample is too thin for more), and levels of routers.
FAN, LEVELS = 64, 6
NEIGHBOURS = 16
#: Of the true neighbours of held-out sample vectors, the share that the parts opened at one level must hold.
RECALL = 0.97
#: Vectors of a block, queries of a chunk. Blocks of a part from which on it is cut by a further level that is shuffled.
BLOCK, CHUNK, BLOCKS = 262_144, 262_144, 16
#: Pairs of a block and a chunk from which on the task fits a router for its block, and the vectors that it fits it on.
PAYS, INNER = 1 << 30, 4096
#: Queries whose scores a task holds at a time, and scores.
HELD, SCORES = 512, 1 << 24


@dataclass(frozen=True)
class Router:
    """Softmax over parts: logits = x @ weights + bias. ``probes``: parts that a query is sent to."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each row, most probable first, ties to the lower part."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")[:, :n]


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` of equal size with few edges of ``graph`` (a row of neighbours for each vertex) between them.

    Start from the order along the second eigenvector of the walk on the graph, then swap pairs of vertices that gain.
    """
    n = len(members)
    at = np.full(graph.shape[0], -1)
    at[members] = np.arange(n)
    cols = at[graph[members]]
    rows = np.repeat(np.arange(n), graph.shape[1])
    ok = cols.ravel() >= 0
    a, b = rows[ok], cols.ravel()[ok]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):
        v = (v + np.bincount(a, v[b], n)) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - (degree - 1)  # edges that are no longer cut if the vertex moves
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum()) // 2  # half of them: neighbours that both move gain nothing
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return members[~side], members[side]


def partition(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each vertex; ``parts`` is a power of two."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(graph.shape[0])]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, g, rng)]
    out = np.zeros(graph.shape[0], dtype=int)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k rows of ``y`` with the largest inner product for each row of ``x``; ``own``: x is y, and a row isn't its own."""
    out = np.empty((len(x), k), dtype=int)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ y.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def train(x: np.ndarray, target: np.ndarray, rounds: int = 40, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression of ``target`` (rows of shares) on ``x``, by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    t = 0
    for step in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 512):
            k = order[i : i + 512]
            z = x[k] @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[k]) / len(k)
            t += 1
            for j, (value, g) in enumerate(((w, x[k].T @ d), (b, d.sum(axis=0)))):
                m, v = state[2 * j], state[2 * j + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                value -= rate * (1 - step / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w, b


def fit(sample: np.ndarray, distinct: int, k: int = 20, recall: float = RECALL, leaf: int = LEAF, fan: int = FAN) -> Router:
    """A router for ``distinct`` vectors from a sample of them (rows, double).

    ``probes`` is the least number of parts that hold ``recall`` of the k nearest other sample vectors of sample vectors
    which the classifier hasn't seen; a ``recall`` of 1 opens all. A sample of under 64 gives one part.
    """
    n, dim = sample.shape if sample.ndim == 2 else (0, 0)
    parts = 1
    while parts < fan and parts * leaf < distinct and n // (2 * parts) >= 32:
        parts *= 2
    if parts == 1 or n < 64:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    scale = np.sqrt((sample**2).sum(axis=1).mean()) or 1.0
    x = sample / scale
    near = nearest(x, x, min(max(NEIGHBOURS, k), n - 1), own=True)
    graph = near[:, :NEIGHBOURS]
    part = partition(graph, parts)
    # A vector belongs to its own part and to its neighbours': what a query needs is where its neighbours are.
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0 / graph.shape[1])
    target = 0.5 * target + 0.5 * np.eye(parts)[part]
    held = np.arange(n) % 8 == 0
    w, b = train(x[~held], target[~held])
    found = Router(w / scale, b, parts)
    placed = found.ranked(sample, 1)[:, 0]
    ranks = np.argsort(found.ranked(sample[held], parts), axis=1)  # of each part, for each held-out vector
    at = np.sort(np.take_along_axis(ranks, placed[near[held][:, :k]], axis=1).ravel())
    probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1
    return Router(w / scale, b, parts if recall >= 1 else probes)


def valid(vector: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite components, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unpack(column, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components, of 4 or 8 bytes each, as doubles."""
    raw = b"".join(column)
    return np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dim * len(column) else np.float64).reshape(-1, dim).astype(np.float64)


def candidates(x: np.ndarray, y: np.ndarray, n: int, router: Router | None) -> Iterator[np.ndarray]:
    """For each row of ``x`` the rows of ``y``, among the parts that ``router`` opens for it (without one: all), that can be among the n with
    the largest inner products: those and what could tie with the last of them, as the matrix product may round another way than the sum."""
    if router is None:
        rows, opened = [np.arange(len(y))], np.zeros((len(x), 1), dtype=int)
    else:
        of = router.ranked(y, 1)[:, 0]
        rows, opened = [np.flatnonzero(of == k) for k in range(len(router.bias))], router.ranked(x, router.probes)
    step = max(1, min(HELD, SCORES // len(y)))
    for i in range(0, len(x), step):
        mine, best, met = opened[i : i + step], [], []
        for k in np.unique(mine):
            if len(rows[k]):
                q, at = np.nonzero(mine == k)
                s = x[i + q] @ y[rows[k]].T
                m = min(n, len(rows[k]))
                best.append((q, at, np.partition(s, len(rows[k]) - m, axis=1)[:, len(rows[k]) - m :]))
                met.append((q, rows[k], s))
        top = np.full((len(mine), mine.shape[1], n), -np.inf)
        for q, at, s in best:
            top[q, at, : s.shape[1]] = s
        top = top.reshape(len(mine), -1)
        least = np.partition(top, top.shape[1] - n, axis=1)[:, top.shape[1] - n]
        edge = np.where(np.isfinite(least), least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.inf)
        found = [(q[r], of_part[c]) for q, of_part, s in met for r, c in [np.nonzero(s >= edge[q][:, None])]]
        q, c = (np.concatenate([f[side] for f in found]) if found else np.empty(0, dtype=int) for side in (0, 1))
        order = np.argsort(q, kind="stable")
        yield from np.split(c[order], np.cumsum(np.bincount(q, minlength=len(mine)))[:-1])


def share(key: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sized(rows: DataFrame, of: DataFrame, counts: str) -> DataFrame:
    """``rows`` joined with ``of`` on node; nodes with many rows (``counts``, a column of ``of``) are dealt out."""
    heavy = hot_keys(of, "node", counts)
    return salted(rows, of, "node", heavy, F.xxhash64("key"))


def routers(index: DataFrame, sizes: DataFrame, dim: int, sample: int, *settings) -> DataFrame:
    """node, weights, bias, probes: a router for each node of ``sizes`` (node, n) that can be cut; ``settings`` are those of fit."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = unpack(pdf["x"], dim)
        found = fit(x, int(pdf["n"].iloc[0]), *settings)
        # A node is left whole if its router sends nearly all of it one way.
        if found.bias.size == 1 or np.bincount(found.ranked(x, 1)[:, 0]).max() > 0.9 * len(x):
            return pd.DataFrame({"node": [], "weights": [], "bias": [], "probes": []}).astype({"node": "int64", "probes": "int32"})
        return pd.DataFrame({"node": [int(pdf["node"].iloc[0])], "weights": [found.weights.tobytes()], "bias": [found.bias.tobytes()], "probes": [found.probes]})

    few = sized(index.select("node", "key", "x"), sizes, "n").where(share("key") * F.col("n") < sample)
    return few.groupBy("node").applyInPandas(one, "node long, weights binary, bias binary, probes int")


def descend(rows: DataFrame, by: DataFrame, dim: int, several: bool) -> DataFrame:
    """``rows`` (node, key, x, ..) a level further down by the routers ``by``, each to its most probable part, or to
    ``several``; rows of nodes without a router stay. Rows of a node meet its router in blocks of bounded size."""
    names, kinds = rows.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    counts = cut(rows.groupBy("node").agg(F.count("*").alias("n")).join(by.select("node"), "node").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "counts")
    moving = sized(rows, counts, "n").withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    ways = by.join(counts.select("node", "blocks"), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def move(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[names].iloc[:0]
        bias = np.frombuffer(right["bias"].iloc[0])
        router = Router(np.frombuffer(right["weights"].iloc[0]).reshape(dim, len(bias)), bias, int(right["probes"].iloc[0]))
        parts = router.ranked(unpack(left["x"], dim), router.probes if several else 1)
        out = left[names].iloc[np.repeat(np.arange(len(left)), parts.shape[1])].copy()
        out["node"] = out["node"].to_numpy() * 256 + 1 + parts.ravel()  # FAN is 128 at most
        return out

    key = ["node", "block"]
    moved = moving.select(*names, "block").groupBy(*key).cogroup(ways.select(*key, "weights", "bias", "probes").groupBy(*key)).applyInPandas(move, kinds)
    return moved.unionByName(rows.join(counts.select("node"), "node", "left_anti").select(*names))


def search(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE, recall: float = RECALL, dim: int | None = None, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row of ``vectors`` (vec_id, embedding) whose
    vec_id is divisible by ``every``, by inner product in double precision, ties to the smaller vec_id, without itself.

    Vectors that are null, zero, of another length than most (ties: the longer) or with components that are null or not
    finite take no part, nor do rows without a vec_id. Fewer than k candidates are all returned. Rows that repeat a
    vec_id, a vector or both are rows of their own: each is a candidate of the others and has its own answer. Other
    columns are ignored. Empty tables give empty results. Every vector is indexed; see SAMPLE for what is fitted on.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    if dim is None:
        top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = top["d"] if top else 0

    width = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [(np.asarray(a, dtype=np.float64) + 0.0).astype(width).tobytes() for a in pdf["v"]]  # -0.0 is 0.0
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "key": [hashlib.md5(b).digest() for b in x], "x": x})

    v = cut(v.where(valid(F.col("v"), dim)).mapInPandas(packed, "vec_id long, key binary, x binary"), "vectors")
    # Classes of equal vectors. Only the k + 1 smallest ids of a class can be among anyone's k nearest; the limit is
    # applied before the shuffle too.
    few = v.select("key", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = few.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = v.groupBy("key").agg(F.first("x").alias("x"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).join(members, "key")
    index = cut(index.select(F.lit(0).cast("long").alias("node"), "key", "ids", "asked", "x"), "index")
    queries = cut(index.where("asked > 0").select("node", "key", "x"), "routed")
    for level in range(LEVELS):
        least = 2 * leaf if level == 0 else max(2 * leaf, BLOCKS * BLOCK)
        sizes = cut(index.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > least), "sizes")
        by = None if sizes.isEmpty() else cut(routers(index, sizes, dim, sample, k, recall, leaf, fan), "routers")
        if by is None or by.isEmpty():
            break
        index = cut(descend(index, by, dim, False), "index")
        queries = cut(descend(queries, by, dim, True), "routed")
    # What a part holds meets what is routed to it.
    loads = index.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    loads = cut(loads.join(queries.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("q")), "node"), "loads")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sized(index, loads, "n").withColumn("block", deal("blocks")).withColumn("chunk", each("chunks")).select("node", "block", "chunk", "key", "ids", "x")
    right = sized(queries, loads, "q").withColumn("chunk", deal("chunks")).withColumn("block", each("blocks")).select("node", "block", "chunk", "key", "x")

    def rank(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(ask):
            return pd.DataFrame({"key": [], "away": [], "vec_id": [], "own": []})
        base = base.sort_values("key")
        y, x, ids, keys, mine = unpack(base["x"], dim), unpack(ask["x"], dim), base["ids"].tolist(), base["key"].tolist(), ask["key"].tolist()
        first = np.array([i[0] for i in ids], dtype=np.int64)
        inner = None
        if len(y) * len(x) >= PAYS and len(y) > 2 * leaf:
            inner = fit(y[np.random.default_rng(7).permutation(len(y))[:INNER]], len(y), k, recall, leaf, fan)
        out = []
        for j, c in enumerate(candidates(x, y, k + 1, inner)):
            exact = (x[j] * y[c]).sum(axis=1)
            order = np.lexsort((first[c], -exact))
            flat, at = [], 0
            # Classes by falling score; those of one score are merged by id.
            while at < len(order) and len(flat) < k + 1:
                s, same = exact[order[at]], []
                while at < len(order) and exact[order[at]] == s:
                    q = c[order[at]]
                    same += [(-s, int(z), keys[q] == mine[j]) for z in ids[q]]
                    at += 1
                flat += sorted(same)
            out.append([np.array(side, dtype=kind) for side, kind in zip(zip(*flat[: k + 1], strict=True), (np.float64, np.int64, bool), strict=True)] if flat else [[], [], []])
        return pd.DataFrame({"key": mine} | {name: [o[i] for o in out] for i, name in enumerate(("away", "vec_id", "own"))})

    parts = ["node", "block", "chunk"]
    near = left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInPandas(rank, "key binary, away array<double>, vec_id array<long>, own array<boolean>")
    lists = F.transform(F.collect_list(F.struct("away", "vec_id", "own")), lambda r: F.arrays_zip(r["away"].alias("away"), r["vec_id"].alias("vec_id"), r["own"].alias("own")))
    best = cut(near.groupBy("key").agg(F.flatten(lists).alias("all")).select("key", F.slice(F.array_sort("all"), 1, k + 1).alias("best")), "best")
    # Each query row of a class gets the class's list without one entry of its own. Rows that are equal are one until the end.
    ask = v.where(F.col("vec_id") % every == 0).groupBy("key", "vec_id").agg(F.count("*").alias("times"))
    heavy = hot_keys(ask.groupBy("key").agg(F.count("*").alias("n")), "key", "n")
    out = salted(ask, best, "key", heavy, F.xxhash64("vec_id")).withColumn("at", F.array_position(F.transform("best", lambda x: x["own"] & (x["vec_id"] == F.col("vec_id"))), True))
    out = out.withColumn("list", F.slice(F.filter("best", lambda x, i: i + 1 != F.col("at")), 1, k)).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode("list").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("x.away")).alias("score"))
