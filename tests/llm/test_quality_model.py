from collections import Counter

import numpy as np
import pytest

from colloquy.llm import quality_model as model


def test_labels_that_no_one_gave_are_found(spark, sf_dir):
    """Held-out accuracy: the labels are used only here."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = model.classify(docs, ["doc_id"], sample=600).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [x.kept for x in r if x.quality == 1], [x.kept for x in r if x.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    n = len(model.LABELLERS)
    accuracy = np.linspace(0.7, 0.95, n)
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        right = rng.random(n) < accuracy
        votes = "".join("0" if rng.random() < 0.2 else "+" if ok == good else "-" for ok in right)
        counts[votes] = counts.get(votes, 0) + 1
    m = model.fit_labels(counts)
    assert abs(m.good_share - 0.7) < 0.05
    assert np.abs(m.given_good[:, 1] - accuracy).max() < 0.05 and np.abs(m.given_bad[:, 2] - accuracy).max() < 0.05
    assert m.posterior("+" * n) > 0.99 > 0.01 > m.posterior("-" * n)
    assert m.posterior("0" * n) == m.good_share or abs(m.posterior("0" * n) - m.good_share) < 1e-9


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "word " * 30_000, 3), (3, "word " * 30_000, 3)], "doc_id long, text string, score int")
    out = model.classify(df)
    assert out.columns == ["doc_id", "text", "score", "votes", "weak_label", "_score", "kept"]
    rows = out.collect()
    assert len(rows) == 4 and len({x["_score"] for x in rows if x.doc_id == 3}) == 1
    assert model.classify(df.limit(0)).count() == 0


def brute(rows, hashes, sample):
    """(doc_id, text) -> weak labels and scores: document by document, with dense features, without vote patterns."""
    names = list(model.LABELLERS)
    facts = [model.Facts.of(t or "", Counter((t or "").split()), (t or "").split()) for _, t in rows]
    votes = np.array([[model.LABELLERS[x](f) for x in names] for f in facts])
    good = np.where((votes == model.BAD).any(axis=1), 0.1, np.where(votes.sum(axis=1) > 0, 0.95, 0.5))
    for _ in range(100):
        share = (good.sum() + 1) / (len(rows) + 2)
        log = np.full(len(rows), np.log(share / (1 - share)))
        for j in range(len(names)):
            p = {}
            for v in (model.GOOD, model.BAD):
                for side, w in (("g", good), ("b", 1 - good)):
                    cast = w[votes[:, j] != model.NONE].sum()
                    p[v, side] = (w[votes[:, j] == v].sum() + 0.5) / (cast + 1)
            log += np.array([0.0 if x == model.NONE else np.log(p[x, "g"] / p[x, "b"]) for x in votes[:, j]])
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    features = []
    for _, t in rows:
        words = (t or "").split()
        f = Counter()
        for w in words:
            for k in model.word_buckets(w):
                f[k] += 1 / len(words)
        for k in model.text_buckets(words, Counter(words)):
            f[k] += 1
        features.append(f)
    first = [i for _, i in sorted({h: i for i, h in reversed(list(enumerate(hashes)))}.items())][:sample]
    used = sorted({k for i in first for k in features[i]})
    x = np.array([[features[i][k] for k in used] for i in first]).reshape(len(first), len(used))
    y = good[first]
    scale = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 0.02), 0.5 / max((y <= 0.5).mean(), 0.02)) / len(first)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    x1 = np.hstack([x, np.ones((len(first), 1))])
    for t in range(1, 121):
        err = (1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50))) - y) * scale
        g = x1.T @ err + np.append(1e-5 * w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weight = dict(zip(used, w, strict=False))
    z = np.array([sum(n * weight.get(k, 0.0) for k, n in f.items()) + w[-1] for f in features])
    return good, 1 / (1 + np.exp(-z))


def test_the_query_is_the_method_document_by_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 90")
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (None, "word " * 5000), (902, "again and again"), (902, "again and again")], docs.schema))
    rows = [(r.doc_id, r.text, r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").collect()]
    weak, score = brute([x[:2] for x in rows], [h for *_, h in rows], 60)
    got = model.classify(docs.selectExpr("*", "1 AS h", "2 AS votes"), ["doc_id", "text"], sample=60).collect()
    key = lambda i, t: (str(i), str(t))
    want = sorted((key(i, t), a, b) for (i, t, _), a, b in zip(rows, weak, score, strict=True))
    found = sorted((key(r.doc_id, r.text), r.weak_label, r.score) for r in got)
    assert [x[0] for x in found] == [x[0] for x in want]
    assert [x[1] for x in found] == pytest.approx([x[1] for x in want], abs=1e-6)
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want], abs=1e-3)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 10) for i in range(200)] + [(5, "text 5 " * 10)] * 300, "doc_id long, text string")
    labels = model.fit_labels({})
    hashes = sorted(r.h for r in df.distinct().selectExpr("xxhash64(doc_id, text) AS h").collect())
    assert len(hashes) == 200
    assert len(model.sample_rows(df, labels, 50)) == 50 and len(model.sample_rows(df, labels, 1000)) == 200
    assert 5 <= len(model.sample_rows(df, labels, 50, 1000)) <= 15 and len(model.sample_rows(df, labels, 50, 1)) == 1
