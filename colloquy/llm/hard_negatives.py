"""Hard negatives by a pivot table.

Each vector x gets one component more, sqrt(M^2 - |x|^2), where M is the greatest length, and an anchor a zero: then
``|a' - x'|^2 = M^2 + |a|^2 - 2 a.x``, so the largest inner product is the smallest distance. Distances obey the triangle
inequality: from those to a few pivots, stored with each row, ``|d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p)`` brackets
the score of any row without reading its vector. Rows lie in blocks, in order of their nearest pivot and the distance
to it; a block, and each stretch of rows within it, knows the least and greatest of its distances. So an anchor goes only to the
blocks, there to the stretches, and there to the rows whose bracket meets what it looks for; the scores of those
are computed exactly.

Two passes: the positives of all anchors, then, as their scores are known, the negatives of all positives. What a bracket has
to beat comes from a bounded sample at first and is tightened by what is found. A task holds one block, of bounded size, and
lets anchors stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Rows that pivots are chosen from, and first bounds taken from: those with #: the least hash, at most so many and so many bytes.
SAMPLE, SAMPLE_BYTES, PIVOTS = 4096, 16 << 20, 8
#: Rows of a block at most, and those that share a stretch; blocks at least, where there are rows for them.
BLOCK, STRETCH, LEAST_BLOCKS, LEAST_ROWS = 65_536, 512, 48, 256
#: Blocks whose bounds an anchor meets at once, and anchors of a group.
PAGE, CHUNK = 1024, 4096
#: Slack of the brackets, as distances are rounded: a share of M^2 + |a|^2.
SLACK = 1e-9
#: Sums below this are exact in double precision.
EXACT = 2.0**53
#: Beyond any score.
FAR = 2**63 - 1


def products(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``x``, whole numbers; ``exact``: doubles hold every sum."""
    if exact:
        return (a @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.array(big(a).dot(big(x).T), dtype=np.int64).reshape(len(a), len(x))


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """``x`` with the component that takes each row to the length sqrt(``most``)."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray, most: float, anchor: bool) -> np.ndarray:
    """From each row to each pivot (augmented); ``anchor``: the rows' further component is 0."""
    own = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p[:-1]) ** 2).sum(axis=1) + (own - p[-1]) ** 2)
    return out


def choose(sample: np.ndarray, n: int, most: float) -> np.ndarray:
    """``n`` rows far from each other, each the farthest from those before; augmented."""
    x = augmented(sample, most)
    out, far = [x[0]], ((x - x[0]) ** 2).sum(axis=1)
    while len(out) < min(n, len(x)):
        out.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def top(row: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best entries of each row, by falling score, ties by id."""
    order = np.lexsort((id_, -score, row))
    r = row[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.array([], dtype=int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return order[rank < k]


class Wanted:
    """What one pass looks for. ``same``: rows of the anchor's own label, else of others. ``low``, ``high``: bounds of the scores
    of each place of each anchor (an array of anchors x places); the ``k`` best within them are kept."""

    def __init__(self, same: bool, k: int, low: np.ndarray, high: np.ndarray):
        self.same, self.k, self.low, self.high = same, k, low.copy(), high

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each anchor can use; least > greatest where there is none."""
        return self.low.min(axis=1), self.high.max(axis=1)


def search_block(x, label, ids, d, a, a_label, da, wanted: Wanted, most: float, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, place, score, id) of what a block's rows give to ``wanted``, and how many scores were computed.

    Rows (x, label, ids, d: distances to pivots) and anchors (a, a_label, da) are arrays; rows are in the block's order.
    """
    whole = most + (a**2).sum(axis=1)
    slack = SLACK * whole
    n_places = wanted.low.shape[1]
    found = [np.empty(0, dtype=np.int64) for _ in range(4)]
    examined = 0
    for at in range(0, len(x), STRETCH):
        rows = slice(at, min(at + STRETCH, len(x)))
        low, high = wanted.reach()
        lo, hi = d[rows].min(axis=0), d[rows].max(axis=0)
        gap = np.maximum(np.maximum(lo - da, da - hi), 0).max(axis=1)
        span = (hi + da).min(axis=1)
        alive = np.flatnonzero((low <= high) & ((whole - gap**2) / 2 + slack >= low) & ((whole - span**2) / 2 - slack <= high))
        if not len(alive):
            continue
        # Brackets of single rows, over the anchors that are still there.
        gap, span = np.zeros((len(alive), rows.stop - at)), np.full((len(alive), rows.stop - at), np.inf)
        for j in range(d.shape[1]):
            mine, theirs = da[alive, j][:, None], d[rows, j][None, :]
            np.maximum(gap, np.abs(mine - theirs), out=gap)
            np.minimum(span, mine + theirs, out=span)
        part, edge = whole[alive][:, None], slack[alive][:, None]
        keep = ((part - gap**2) / 2 + edge >= low[alive][:, None]) & ((part - span**2) / 2 - edge <= high[alive][:, None])
        keep &= (label[rows][None, :] == a_label[alive][:, None]) == wanted.same
        some = np.flatnonzero(keep.any(axis=0))
        if not len(some):
            continue
        s, keep = products(a[alive], x[rows][some], exact), keep[:, some]
        examined += int(keep.sum())
        for place in range(n_places):
            hit = keep & (s >= wanted.low[alive, place][:, None]) & (s <= wanted.high[alive, place][:, None])
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            new = (alive[r], np.full(len(r), place), s[r, c], ids[rows][some][c])
            found = [np.concatenate(p) for p in zip(found, new, strict=True)]
            best = top(found[0] * n_places + found[1], found[2], found[3], wanted.k)
            found = [p[best] for p in found]
            # The k-th best so far is what the next rows have to reach; found is in order of anchor and place.
            key = found[0] * n_places + found[1]
            last = np.flatnonzero(np.bincount(key, minlength=len(a) * n_places) >= wanted.k)
            end = np.searchsorted(key, last, side="right") - 1
            flat = wanted.low.reshape(-1)
            flat[last] = np.maximum(flat[last], found[2][end])
    return (*found, examined)


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x (doubles, floor(256 x)) of the rows that take part: with an id, a label, and a vector of at least
    one component of which all are finite, also 256-fold; of vectors of different lengths, those of the most frequent one (ties:
    the longer). Labels of ids divisible by 7 are moved on by one, after 9 to 0."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double")).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & good)
    usual = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return v.where(F.size("v") == (usual["d"] if usual else 0)).select("vec_id", label.alias("label"), "v")


def arrays(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """A binary column of doubles as rows."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.float64).reshape(-1, dim)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def tuned(matrix: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(matrix, dtype=np.float64)]


class Table:
    """The pivot table of ``vectors`` (vec_id, label, embedding): rows in blocks with their distances, and the blocks' bounds."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, block: int = BLOCK):
        plain = packed(vectors)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column("v")
                if len(b):
                    flat = np.floor(v.flatten().to_numpy(zero_copy_only=False)).reshape(len(b), -1) + 0.0  # -0.0 is 0.0
                    yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "label": b.column("label"), "x": tuned(flat), "norm": (flat**2).sum(axis=1)})

        rows = cut(plain.mapInArrow(pack, "vec_id long, label long, x binary, norm double"), "vectors")
        whole = rows.agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.max(F.length("x")).alias("bytes")).first()
        self.n, self.most, self.dim = whole["n"], float(whole["most"] or 0.0), (whole["bytes"] or 0) // 8
        self.exact = self.most < EXACT
        spark = rows.sparkSession
        at_most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * self.dim or 1)))
        few = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(at_most).collect() if self.n else []
        self.sample = np.frombuffer(b"".join(r["x"] for r in few), dtype=np.float64).reshape(len(few), self.dim) if few else np.empty((0, self.dim))
        self.sample_label, self.sample_id = np.array([r["label"] for r in few], dtype=np.int64), np.array([r["vec_id"] for r in few], dtype=np.int64)
        self.pivots = choose(self.sample, pivots, self.most) if few else np.empty((0, self.dim + 1))
        at, most = self.pivots, self.most

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                d = distances(arrays(b, "x", at.shape[1] - 1), at, most, False)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "label": b.column("label"), "x": b.column("x"), "norm": b.column("norm"), "d": tuned(d), "cell": cell.astype(np.int32), "near": d[np.arange(len(d)), cell]})

        blocks = max(1, -(-self.n // block), min(LEAST_BLOCKS, self.n // LEAST_ROWS))
        placed = rows.mapInArrow(measure, "vec_id long, label long, x binary, norm double, d binary, cell int, near double") if self.n else spark.createDataFrame([], "vec_id long, label long, x binary, norm double, d binary, cell int, near double")
        # Ranges of rows; equal vectors are dealt by their hash, so no block is larger for them.
        dealt = placed.withColumn("salt", F.xxhash64("vec_id", "label")).repartitionByRange(blocks, "cell", "near", "salt")
        self.rows = cut(dealt.withColumn("block", F.spark_partition_id()).select("block", "vec_id", "label", "x", "norm", "d", "cell", "near"), "blocks")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block_, d = numbers(b, "block"), arrays(b, "d", len(at))
                for k in np.unique(block_):
                    mine = d[block_ == k]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([int(k)] * len(at), pa.int32()), "j": pa.array(range(len(at)), pa.int32()), "lo": mine.min(axis=0), "hi": mine.max(axis=0)})

        ends = self.rows.select("block", "d").mapInArrow(bounds, "block int, j int, lo double, hi double") if self.n else spark.createDataFrame([], "block int, j int, lo double, hi double")
        ends = ends.groupBy("block", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        self.blocks = cut(ends.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("j", "lo", "hi"))).alias("ends")), "bounds")

    def route(self, anchors: DataFrame, low: str, high: str) -> DataFrame:
        """``anchors`` (aid, x, ..) with a row for each block that may hold a score from ``low`` to ``high``: block.

        Bounds of blocks come in pages of PAGE, anchors in chunks of CHUNK; a task meets one of each.
        """
        at, most, dim = self.pivots, self.most, self.dim
        pages, n = -(-self.blocks.count() // PAGE), anchors.count()
        chunks = max(1, -(-n // CHUNK))
        left = anchors.select("aid", "x", F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")).withColumn("chunk", F.pmod(F.xxhash64("aid"), F.lit(chunks)).cast("int")).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max(0, pages - 1)))))
        right = self.blocks.select((F.col("block") / PAGE).cast("int").alias("page"), "block", "ends").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return pa.table({"aid": pa.array([], pa.binary()), "block": pa.array([], pa.int32())})
            x = np.frombuffer(b"".join(a.column("x").to_pylist()), dtype=np.float64).reshape(-1, dim)
            da, whole = distances(x, at, most, True), most + (x**2).sum(axis=1)
            lo_, hi_ = a.column("low").to_numpy(), a.column("high").to_numpy()
            ids, aid, block = [], a.column("aid").to_pylist(), []
            for k, ends in zip(b.column("block").to_pylist(), b.column("ends").to_pylist(), strict=True):
                lo, hi = np.array([e["lo"] for e in ends]), np.array([e["hi"] for e in ends])
                gap, span = np.maximum(np.maximum(lo - da, da - hi), 0).max(axis=1), (hi + da).min(axis=1)
                for i in np.flatnonzero((lo_ <= hi_) & ((whole - gap**2) / 2 + SLACK * whole >= lo_) & ((whole - span**2) / 2 - SLACK * whole <= hi_)):
                    ids.append(aid[i])
                    block.append(k)
            return pa.table({"aid": pa.array(ids, pa.binary()), "block": pa.array(block, pa.int32())})

        key = ["page", "chunk"]
        ways = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "aid binary, block int")
        return ways.join(anchors, "aid")

    def visit(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        """aid, place, vec_id, score: the ``k`` best of each block for each place of each anchor that was sent to it.

        ``routed``: block, aid, label, x, low, high (arrays of bounds, one for each place). A block's rows come first and are
        held; then its anchors stream past.
        """
        at, most, dim, exact = self.pivots, self.most, self.dim, self.exact
        null = lambda t: F.lit(None).cast(t)
        base = self.rows.select("block", F.lit(0).alias("kind"), "cell", "near", "vec_id", "label", "x", "d", null("binary").alias("aid"), null("array<long>").alias("low"), null("array<long>").alias("high"))
        asks = routed.select("block", F.lit(1).alias("kind"), F.lit(0).alias("cell"), F.lit(0.0).alias("near"), null("long").alias("vec_id"), "label", "x", null("binary").alias("d"), "aid", "low", "high")
        parts = max(1, min(self.blocks.count(), 100_000))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, rows = None, [], None
            for b in batches:
                block, kind = numbers(b, "block"), numbers(b, "kind")
                ends = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]) if len(b) else []
                for i, start in enumerate(ends):
                    piece = b.slice(start, (ends[i + 1] if i + 1 < len(ends) else len(b)) - start)
                    if block[start] != now:
                        now, held, rows = block[start], [], None
                    if kind[start] == 0:
                        held.append((arrays(piece, "x", dim), numbers(piece, "label"), numbers(piece, "vec_id"), arrays(piece, "d", len(at))))
                        continue
                    if rows is None:
                        rows, held = [np.concatenate(p) for p in zip(*held, strict=True)], []
                    a = arrays(piece, "x", dim)
                    low, high = (np.array(piece.column(c).to_pylist(), dtype=np.int64) for c in ("low", "high"))
                    r, place, score, ids, _ = search_block(*rows, a, numbers(piece, "label"), distances(a, at, most, True), Wanted(same, k, low, high), most, exact)
                    aid = piece.column("aid").to_pylist()
                    yield pa.RecordBatch.from_pydict({"aid": pa.array([aid[j] for j in r], pa.binary()), "place": pa.array(place, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

        both = base.unionByName(asks).repartition(parts, "block").sortWithinPartitions("block", "kind", "cell", "near")
        return both.mapInArrow(fold, "aid binary, place int, vec_id long, score long")

    def anchors(self, every: int) -> DataFrame:
        """aid, vec_id, label, x, times, norm: the rows whose id is divisible by ``every``, equal rows once."""
        some = self.rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "label", "x").agg(F.count("*").alias("times"), F.first("norm").alias("norm"))
        return some.withColumn("aid", F.unhex(F.md5(F.concat(F.col("vec_id").cast("string").cast("binary"), F.lit("|").cast("binary"), F.col("label").cast("string").cast("binary"), F.lit("|").cast("binary"), F.col("x")))))

    def bounded(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchors`` (aid, label, x, low, high) with ``low`` raised to the k-th best score that the sample has within the bounds."""
        sample, s_label, exact, dim = self.sample, self.sample_label, self.exact, self.dim

        def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                low, high = (np.array(b.column(c).to_pylist(), dtype=np.int64) for c in ("low", "high"))
                labels, x = numbers(b, "label"), arrays(b, "x", dim)
                for i in range(0, len(b), 256):
                    s = products(x[i : i + 256], sample, exact)
                    other = (s_label[None, :] == labels[i : i + 256, None]) != same  # not looked for
                    for place in range(low.shape[1]):
                        l, h = low[i : i + 256, place], high[i : i + 256, place]
                        inside = np.where(other | (s < l[:, None]) | (s > h[:, None]), np.iinfo(np.int64).min, s)
                        if s.shape[1] >= k:
                            l[:] = np.maximum(l, np.partition(inside, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                yield pa.RecordBatch.from_pydict({"aid": b.column("aid"), "label": b.column("label"), "x": b.column("x"), "low": pa.array(low.tolist(), pa.list_(pa.int64())), "high": b.column("high")})

        return anchors.select("aid", "label", "x", "low", "high").mapInArrow(raise_, "aid binary, label long, x binary, low array<long>, high array<long>")

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """aid, place, rank, vec_id, score: the ``k`` best rows of the whole table for each place of each anchor, by score, ties by id."""
        asked = cut(self.bounded(anchors, same, k), "anchors").withColumns({"least": F.array_min("low"), "most": F.array_max("high")})
        routed = self.route(asked, "least", "most").select("block", "aid", "label", "x", "low", "high")
        order = Window.partitionBy("aid", "place").orderBy(F.desc("score"), "vec_id")
        return self.visit(routed, same, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("aid", "place", "rank", "vec_id", "score")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row whose vec_id is
    divisible by ``every``) and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of
    other labels whose score is at least ``percent`` hundredths of the positive's and at most the positive's.

    Scores are inner products of whole numbers (see :func:`packed`, also for the rows that take no part), the largest
    first, ties by vec_id. Rows that repeat an id, a vector or both are rows of their own: an anchor is only left out of its own positives
    itself, and repeated anchors and positives repeat their answers. Other columns are ignored. Empty tables give
    empty results, as do anchors with a negative best score: no score is within their bounds.
    """
    table = Table(vectors)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not table.n:
        return vectors.sparkSession.createDataFrame([], out)
    anchors = cut(table.anchors(every), "anchors")
    asked = anchors.select("aid", "label", "x", F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high"))
    # One more than asked for, as the anchor itself may be among them: of the entries with its id, that with its own score goes.
    entry = F.struct("rank", "vec_id", "score")
    near = table.best(asked, True, positives + 1).groupBy("aid").agg(F.array_sort(F.collect_list(entry)).alias("near")).join(anchors, "aid")
    own = F.array_min(F.transform(F.filter("near", lambda e: e["vec_id"] == F.col("vec_id")), lambda e: F.struct(F.abs(e["score"] - F.col("norm")).alias("off"), e["rank"].alias("rank"))))["rank"]
    near = near.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("near", F.slice(F.filter("near", lambda e: e["rank"] != F.col("own")), 1, positives))
    near = cut(near.select("aid", "label", "x", "times", F.col("vec_id").alias("anchor_id"), F.transform("near", lambda e: e["score"]).alias("high"), F.transform("near", lambda e: e["vec_id"]).alias("ids")), "positives")
    # ceil(percent / 100 of the score), in two parts, as the product may not fit; div and % cut towards zero.
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    share = F.transform("high", lambda s: div(s, 100) * percent + div(s % 100 * percent + F.when(s < 0, 0).otherwise(99), 100))
    full = lambda c, by: F.slice(F.concat(c, F.array_repeat(F.lit(by), positives)), 1, positives)
    asked = near.where(F.exists("high", lambda s: s >= 0)).select("aid", "label", "x", full(share, FAR).alias("low"), full(F.col("high"), -FAR).alias("high"))
    found = table.best(asked, False, negatives).join(near.select("aid", "anchor_id", "times", "ids", F.col("high").alias("scores")), "aid")
    at = F.col("place") + 1
    found = found.select("anchor_id", F.element_at("ids", at).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.element_at("scores", at).alias("positive_score"), F.col("score").alias("negative_score"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("again"))
    return found.drop("again")
