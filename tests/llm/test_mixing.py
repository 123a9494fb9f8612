import re
from collections import defaultdict
from fractions import Fraction

import pytest

from colloquy.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, cap=3):
    """Reshare the excess until no target is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = Fraction(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 7}") for i in range(900)] + [(2000 + i, "one two", "tiny") for i in range(3)] + [(3000, None, "void"), (3001, "a b c", None), (None, "x", "s1"), (3002, "", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, df, mixing.mix(df).collect()


def test_targets_reshare_what_capped_sources_cannot_take(mixed):
    rows, _, got = mixed
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = shares(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]))


def test_taken_words_come_within_a_document_of_the_target(mixed):
    rows, _, got = mixed
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in rows)
    taken, largest, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree_and_rows_are_taken_as_decided(mixed):
    _, df, got = mixed
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    wide = df.withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS passes", "2 AS h", "3 AS s")
    kept = mixing.apply(wide)
    assert kept.columns == wide.columns
    want = sorted(str(r.doc_id) for r in got for _ in range(r.times))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


@pytest.mark.parametrize("copies, others", [(1000, 0), (999, 500), (2, 3)])
def test_of_repeated_rows_as_many_are_taken_as_the_target_asks_for(spark, copies, others):
    rows = [(7, "ten words are in here " * 2, "a")] * copies + [(i, "one two three", "b") for i in range(100, 100 + others)] + [(50, "w " * 9 * copies, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = {s: sum(len(WORDS.findall(t)) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    want = shares(size)
    for s in want:
        taken = sum(r.taken for r in got if r.source == s)
        largest = max(len(WORDS.findall(t)) for _, t, x in rows if x == s)
        assert abs(taken - want[s]) <= largest / 2 + 1e-6
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = mixing.apply(df)
    assert {s: sum(len(WORDS.findall(r.text)) for r in kept.collect() if r.source == s) for s in want} == {s: sum(r.taken for r in got if r.source == s) for s in want}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
