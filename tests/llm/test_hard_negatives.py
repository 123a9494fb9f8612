import math
import random

import numpy as np
import pytest

from colloquy.llm import hard_negatives
from colloquy.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, dim=4):
    """Every anchor against every row; rows are told apart by their places."""
    good = []
    for id_, v, label in rows:
        if id_ is None or v is None or label is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((id_, [math.floor(256 * x) for x in v], (label + 1) % 10 if id_ % 7 == 0 else label))
    out = []
    for i, (a, v, label) in enumerate(good):
        if a % every:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other == label) for j, (b, w, other) in enumerate(good) if j != i)
        for s, b, _ in [x for x in others if x[2]][:5]:
            found = [x for x in others if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, b, k, x[1], -s, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def some(n, dim=4, seed=3, clusters=5, noise=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, noise) for c in centres[i % clusters]], rng.randrange(4)) for i in range(n)]


def test_against_every_pair(spark):
    rows = some(1500)
    # Repeated ids, repeated vectors, repeated rows, anchors among them; rows that take no part.
    rows += [rows[100], rows[200], rows[200], (300, [0.5, 0.5, 0.5, 0.5], 1), (300, [0.5, 0.5, 0.5, 0.25], 1), (2100, [0.0] * 4, 2)] + [(3000 + i, [1.0, 1.0, 1.0, 1.0], i % 3) for i in range(400)]
    rows += [(None, [1.0] * 4, 1), (2200, None, 1), (2300, [1.0] * 4, None), (2400, [1.0, None, 1.0, 1.0], 1), (2500, [1.0, float("nan"), 1.0, 1.0], 1), (2600, [1.0, float("inf"), 1.0, 1.0], 1), (2700, [1.0, 2.0], 1), (2800, [], 1), (2900, [1e308, 1e308, 0.0, 0.0], 1)]
    random.Random(1).shuffle(rows)
    want = brute([r for r in rows if r[0] != 2900])
    assert len(want) > 100
    assert rows_of(mine(spark.createDataFrame(rows, SCHEMA))) == want


def test_negative_and_large_scores(spark):
    rows = [(i, [-(1.0 + i % 3) if i % 100 else 1.0, 0.5], i % 2) for i in range(1, 320)]
    assert rows_of(mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows, dim=2)
    big = [(i, [2.0**22 + i * 2.0**-3, float(i % 5) * 2.0**20], i % 2) for i in range(230)]  # scores of more than 53 bits
    assert rows_of(mine(spark.createDataFrame(big, SCHEMA))) == brute(big, dim=2)


def test_empty_and_clashing(spark):
    assert mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine(spark.createDataFrame([(1, [1.0], 1), (100, None, 1)], SCHEMA)).count() == 0
    assert mine(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0
    rows = some(300)
    wide = spark.createDataFrame([(*r, 1, b"x", 2) for r in rows], SCHEMA + ", block int, x binary, rank int")
    assert rows_of(mine(wide)) == brute(rows)


def test_brackets_hold_and_spare_most_rows_of_clusters():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 32)) * 0.05
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    most = float((x**2).sum(axis=1).max())
    pivots = hard_negatives.choose(x[:2000], 16, most)
    d = hard_negatives.distances(x, pivots, most, False)
    order = np.lexsort((d.min(axis=1), d.argmin(axis=1)))
    x, d = x[order], d[order]
    a = x[::500]
    da = hard_negatives.distances(a, pivots, most, True)
    s = (a @ x.T).astype(np.int64)
    whole = (most + (a**2).sum(axis=1))[:, None]
    gap, span = np.abs(da[:, None, :] - d[None]).max(axis=2), (da[:, None, :] + d[None]).min(axis=2)
    assert ((whole - gap**2) / 2 + 1e-3 >= s).all() and ((whole - span**2) / 2 - 1e-3 <= s).all()
    label = np.zeros(len(x), dtype=np.int64)
    low = np.sort(s, axis=1)[:, -50][:, None]
    wanted = hard_negatives.Wanted(True, 6, low, np.full_like(low, hard_negatives.FAR))
    row, _, score, ids, examined = hard_negatives.search_block(x, label, np.arange(len(x)), d, a, label[: len(a)], da, wanted, most, True)
    for i in range(len(a)):
        best = np.lexsort((np.arange(len(x)), -s[i]))[:6]
        assert ids[row == i].tolist() == best.tolist() and score[row == i].tolist() == s[i][best].tolist()
    assert examined < 0.25 * s.size


@pytest.mark.parametrize("block", [64, 400])
def test_blocks_and_pages(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "PAGE", 2)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    table = hard_negatives.Table(spark.createDataFrame(some(900), SCHEMA), block=block)
    counts = [r["count"] for r in table.rows.groupBy("block").count().collect()]
    assert sum(counts) == 900 and len(counts) > 1 and max(counts) < 2.5 * block
    assert rows_of(mine(spark.createDataFrame(some(900), SCHEMA))) == brute(some(900))
