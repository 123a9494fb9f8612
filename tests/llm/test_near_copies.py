import random
import time
from collections import defaultdict

import numpy as np
import pytest

from colloquy.llm import near_copies as near


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randint(0, 5) for _ in range(r.randint(1, 30))]
        b = [x for x in a if r.random() < 0.9] or [1]
        b.insert(r.randint(0, len(b)), 9)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert near.common(x, y, 64) == lcs(a, b)
        want = lcs(a, b) / (len(a) + len(b) - lcs(a, b))
        got = near.similarity(x, y)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want))


@pytest.mark.parametrize("listed", [near.LISTED, 0])
def test_both_ways_of_alignment_agree_with_the_table(listed, monkeypatch):
    monkeypatch.setattr(near, "LISTED", listed)
    monkeypatch.setattr(near, "ROWS", 7)
    r = random.Random(4)
    for _ in range(200):
        a = [r.randint(0, 12) for _ in range(r.randint(1, 80))]
        b = [r.randint(0, 12) if r.random() < 0.1 else x for x in a if r.random() < 0.95] or [1]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        want = lcs(a, b) / (len(a) + len(b) - lcs(a, b))
        got = near.similarity(x, y)
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or got == pytest.approx(want)) and got <= want + 1e-12


def test_very_long_texts_align_within_a_second():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**32, 160_000, dtype=np.uint32)
    b = np.delete(a, rng.integers(0, len(a), 8_000))
    began = time.process_time()
    assert near.similarity(a, b) > 0.9
    assert time.process_time() - began < 1
    lines = np.tile(np.arange(40, dtype=np.uint32), 500)  # a few lines again and again: every place matches 500
    began = time.process_time()
    assert near.similarity(lines, np.delete(lines, [5, 900, 7_000])) > 0.99
    assert time.process_time() - began < 5


def test_order_matters_and_repeats_are_told_apart():
    a = near.shingles("a b c d e f g h " * 30)
    assert len(np.unique(near.labelled(a))) == len(a)
    words = [f"w{i}" for i in range(200)]
    moved = words[100:] + words[:100]
    x, y = near.shingles(" ".join(words)), near.shingles(" ".join(moved))
    same = sum(near.sketch(x) == near.sketch(y))
    assert same < near.SKETCHES * 0.8 and near.similarity(near.sequence(x), near.sequence(y)) < 0.8


def test_classes_are_the_components_of_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    docs = []

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(words)
        return w

    base, passage = [r.choice(words) for _ in range(200)], [r.choice(words) for _ in range(55)]
    docs += [" ".join(edited(base, 3)) for _ in range(60)]
    docs += [" ".join([r.choice(words) for _ in range(100)] + passage) for _ in range(60)]
    for _ in range(15):
        b = [r.choice(words) for _ in range(120)]
        docs += [" ".join(b), " ".join(edited(b, 2)), " ".join(b)]
    rows = list(enumerate(docs)) + [(900, ""), (901, None), (902, "  "), (903, "a b"), (904, "a  b"), (905, "a b c"), (None, "a b"), (903, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seq = [near.sequence(near.shingles(t or "")) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near.similarity(seq[i], seq[j]) >= 0.8:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    want = sorted((str(rows[i][0]), str(min((rows[k][0] for k in m if rows[k][0] is not None), default=None))) for m in members.values() for i in m)
    got = near.classes(df).collect()
    assert sorted((str(x.doc_id), str(x.class_id)) for x in got) == want
    wide = df.selectExpr("*", "1 AS t", "2 AS _t", "3 AS class_id")
    kept = near.first_of_each(wide)
    assert kept.columns == wide.columns and kept.count() == len(members)


def test_a_family_that_drifts_is_one_class_where_brute_force_says_so(spark):
    """250 texts, each an edit of the one before it: neighbours are similar enough, the ends are not."""
    r = random.Random(8)
    word = iter(f"w{i}" for i in range(10**6))
    now, docs = [next(word) for _ in range(200)], []
    for _ in range(250):
        docs.append(list(now))
        for _ in range(r.choice([1, 1, 2, 4, 9])):
            now[r.randrange(len(now))] = next(word)
    seq = [near.sequence(near.shingles(" ".join(w))) for w in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(max(0, i - 40), i):
            if near.similarity(seq[i], seq[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert near.similarity(seq[0], seq[40]) == 0 or near.similarity(seq[0], seq[40]) < 0.8
    df = spark.createDataFrame([(str(i).zfill(4), " ".join(w)) for i, w in enumerate(docs)], "doc_id string, text string")
    assert {x.doc_id: x.class_id for x in near.classes(df).collect()} == {str(i).zfill(4): str(find(i)).zfill(4) for i in range(len(docs))}


def test_long_chains_come_together_in_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(near, "cut", lambda df, name, cut=near.cut: steps.append(name) or cut(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {x.v: x.c for x in near.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900} and len(steps) < 30


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(df).count() == 0 and near.first_of_each(df).count() == 0


def test_links_of_few_members_are_found(spark):
    """Two families in one bucket whose leaders are too far apart: only two members, one of each, are similar enough."""
    r = random.Random(3)
    word = iter(f"w{i}" for i in range(10**6))
    base = [next(word) for _ in range(400)]

    def put(w, places):
        w = list(w)
        for i in places:
            w[i] = next(word)
        return w

    one, two = put(base, range(0, 40)), put(base, range(360, 400))
    docs = [base, one, two] + [put(one, r.sample(range(60, 340), 1)) for _ in range(500)] + [put(two, r.sample(range(60, 340), 1)) for _ in range(500)]
    seq = [near.sequence(near.shingles(" ".join(w))) for w in docs]
    assert near.similarity(seq[0], seq[1]) >= 0.8 and near.similarity(seq[0], seq[2]) >= 0.8 and near.similarity(seq[1], seq[2]) < 0.8
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert near.classes(df).select("class_id").distinct().count() == 1


def test_cross_pairs_lose_nothing(spark):
    """Every similar pair of different classes is a candidate; texts that share a passage only are not."""
    r = random.Random(9)
    word = iter(f"w{i}" for i in range(10**6))
    passage = [next(word) for _ in range(150)]
    docs = [passage + [next(word) for _ in range(60)] for _ in range(80)]
    for _ in range(40):
        b = [next(word) for _ in range(r.randint(20, 200))]
        docs.append(b)
        for _ in range(3):
            w = list(b)
            for _ in range(r.randint(1, max(1, len(b) // 40))):
                w[r.randrange(len(w))] = next(word)
            docs.append(w + [next(word) for _ in range(r.randint(0, 3))])
    seq = [near.sequence(near.shingles(" ".join(w))) for w in docs]
    rows = [(i.to_bytes(4, "big"), bytes([i % 3]), seq[i].tobytes()) for i in range(len(docs))]
    got = {(x.t, x.leader) for x in near.cross_pairs(spark.createDataFrame(rows, "t binary, c binary, seq binary"), len(rows), 0.8).collect()}
    want = {(rows[j][0], rows[i][0]) for i in range(len(rows)) for j in range(i) if rows[i][1] != rows[j][1] and near.similarity(seq[i], seq[j]) >= 0.8}
    assert want and want <= {(bytes(a), bytes(b)) for a, b in got}
    assert not any(max(a, b) < (80).to_bytes(4, "big") for a, b in got)
