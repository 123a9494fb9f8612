import numpy as np
import pytest

from colloquy.llm import neighbours


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (m * m[q]).sum(axis=1)
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != q][:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(100)]
    return rows + [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [1.0] * 3), (None, [1.0] * 8), (5080, [float("inf")] + [1.0] * 7)]


def answers(got):
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_all_parts_give_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS key", "3 AS x")
    got, want = answers(neighbours.search(df, leaf=2000).collect()), brute(rows)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [(n, v) for n, v, _ in found] == [(n + 1, v) for n, (v, _) in enumerate(want[q])]
        assert np.allclose([s for *_, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_parts_that_are_all_opened_give_brute_force(spark, rows, monkeypatch):
    """Two levels of routers, blocks and chunks of a few rows, and every part opened."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(neighbours.search(df, recall=1.0, leaf=40, fan=4).collect()), brute(rows)
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_few_parts_hold_the_neighbours_where_vectors_cluster(spark, monkeypatch):
    """Recall of at least 0.9 with fewer than half of the parts opened."""
    rng = np.random.default_rng(5)
    centres = 3 * rng.standard_normal((60, 8))
    rows = [(i, (centres[i % 60] + rng.standard_normal(8)).tolist()) for i in range(3000)]
    seen = []
    monkeypatch.setattr(neighbours, "cut", lambda df, name, cut=neighbours.cut: (out := cut(df, name), seen.append((name, out)))[0])
    want = brute(rows)
    got = answers(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=64).collect())
    assert sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    parts = [df for name, df in seen if name == "index"][-1].select("node").distinct().count()
    opened = [df for name, df in seen if name == "routed"][-1].count() / len(want)
    assert parts >= 30 and opened < parts / 2


def test_recall_on_the_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x = np.array([v for _, v in rows], dtype=float)
    ids = np.array([i for i, _ in rows])
    hits = total = 0
    for q, found in answers(neighbours.search(table).collect()).items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
        total += 20
    assert hits >= 0.9 * total


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((8, 6)) * 4, 40, axis=0) + 0.1 * rng.standard_normal((320, 6))
    graph = neighbours.nearest(x, x, 8, own=True)
    part = neighbours.partition(graph, 8)
    assert np.bincount(part).tolist() == [40] * 8
    assert (part[graph] == part[:, None]).mean() > 0.6


def test_few_rows(spark):
    """Rows that repeat an id, a vector or both are rows of their own."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.0, 2.0]), (40, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.search(df).collect()))
    one = [(20, 1, 20, 1.0), (20, 2, 40, 1.0), (20, 3, 21, 0.5), (20, 4, 40, 0.0)]
    assert got == sorted([*one, *one, (40, 1, 20, 1.0), (40, 2, 20, 1.0), (40, 3, 21, 0.5), (40, 4, 40, 0.0), (40, 1, 21, 1.0), (40, 2, 20, 0.0), (40, 3, 20, 0.0), (40, 4, 40, 0.0)])
    assert neighbours.search(df.limit(0)).count() == 0
    zero = spark.createDataFrame([(20, [0.0]), (None, [1.0]), (40, None)], "vec_id long, embedding array<float>")
    assert neighbours.search(zero).count() == 0


def test_a_task_that_cuts_its_block_gives_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "PAYS", 1)
    monkeypatch.setattr(neighbours, "HELD", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = answers(neighbours.search(df, recall=1.0, leaf=100, fan=4).collect()), brute(rows)
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_a_query_is_copied_for_the_parts_of_one_level_alone(spark, monkeypatch):
    """Parts of more than twice a leaf, but less than some blocks, aren't cut by a level that is shuffled."""
    rng = np.random.default_rng(6)
    seen = []
    monkeypatch.setattr(neighbours, "cut", lambda df, name, cut=neighbours.cut: (out := cut(df, name), seen.append((name, out)))[0])
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(2000)], "vec_id long, embedding array<float>")
    neighbours.search(df, leaf=40, fan=4).count()
    assert [name for name, _ in seen].count("routers") == 1
    assert [df for name, df in seen if name == "routed"][-1].count() <= 4 * 100
    assert len([df for name, df in seen if name == "index"][-1].first()["x"]) == 8 * 4  # as narrow as it is given


def test_candidates_of_opened_parts_are_theirs():
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((50, 6)), rng.standard_normal((3000, 6))
    router = neighbours.fit(y[:1000], 3000, 20, 0.9, 100, 16)
    assert 1 < router.probes < len(router.bias)
    for q, c, parts in zip(x, neighbours.candidates(x, y, 21, router), router.ranked(x, router.probes), strict=True):
        mine = np.flatnonzero(np.isin(router.ranked(y, 1)[:, 0], parts))
        assert set(mine[np.argsort(-(y[mine] @ q), kind="stable")[:21]]) <= set(c) <= set(mine)
