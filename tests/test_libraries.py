"""Whole libraries: similar pairs, components, chains and identities, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import identity
from colloquy.components import connected, ends
from colloquy.similar import Pairs

VOICES = "id long, embedding array<double>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if r is None else [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], VOICES)


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= least}


def clustered(n, clusters, dim, noise, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * noise


@pytest.mark.parametrize("least, noise", [(0.8, 0.3), (0.95, 0.2), (0.3, 0.8)])
def test_all_similar_pairs_and_no_others(spark, least, noise):
    x = clustered(700, 30, 12, noise)
    x[10:14] = x[3]  # equal vectors
    x[20] = x[3] * 7  # equal but for their length
    got = {(r.a, r.b): r.cosine for r in Pairs(frame(spark, x), least, pivots=16, chunk=64).found().collect()}
    assert set(got) == brute(x, least)
    assert all(abs(c - x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])) < 1e-9 for (a, b), c in got.items())


def test_vectors_that_have_no_pairs(spark):
    x = [[1.0, 0.0], [1.0, 0.01], None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [], [1e-200, 0.0]]
    assert {(r.a, r.b) for r in Pairs(frame(spark, x), 0.9).found().collect()} == {(0, 1), (0, 7), (1, 7)}
    empty = Pairs(frame(spark, []), 0.9)
    assert empty.found().count() == 0 and empty.met() == 0
    with pytest.raises(ValueError):
        Pairs(frame(spark, x), 0.0)


def test_a_row_goes_once_to_each_group_of_blocks(spark):
    """However many blocks it visits: random directions leave nothing to rule out. In single precision nothing is lost either."""
    x = np.random.default_rng(6).normal(size=(3000, 10))
    pairs = Pairs(frame(spark, x), 0.75, chunk=1000)
    groups = pairs.units[0].select("group").distinct().count()
    assert groups <= 7 and pairs.units[1].count() <= 3000 * groups
    assert {(r.a, r.b) for r in pairs.found().collect()} == brute(x, 0.75)


def test_few_pairs_are_compared(spark):
    """The voices of the 0.1 tables as one library, against brute force."""
    from colloquy.domain import statement

    v = statement(spark, "/root/testdata/sf0.1", "SELECT vec_id AS id, embedding FROM vectors")
    rows = sorted((r.id, r.embedding) for r in v.collect())
    pairs = Pairs(v, 0.8)
    want = brute(np.array([r[1] for r in rows]), 0.8)
    assert {(r.a, r.b) for r in pairs.found().collect()} == {(rows[i][0], rows[j][0]) for i, j in want}
    assert pairs.met() < 0.6 * len(rows) * (len(rows) - 1) / 2
    close = Pairs(frame(spark, clustered(3000, 100, 24, 0.05)), 0.9)
    assert close.met() < 0.1 * 3000 * 2999 / 2


def components_of(n, edges):
    of = list(range(n))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    n = spark.range(600).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in connected(n, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of(600, edges)
    assert {r.component for r in connected(n, spark.createDataFrame([], "a long, b long")).collect()} == set(range(600))


def test_a_large_component_of_a_large_library(spark):
    """20,000 voices in one library, 5,000 of them in one component: a chain of similar voices, none of which is like all others."""
    t = np.arange(5000) * 0.004
    chain = np.column_stack([np.cos(t), np.sin(t), np.zeros(5000), np.zeros(5000)]) * 0.7 + np.column_stack([np.zeros((5000, 2)), np.cos(t * 1.7), np.sin(t * 1.7)]) * 0.7
    rng = np.random.default_rng(4)
    apart = np.hstack([np.zeros((15_000, 4)), rng.normal(size=(15_000, 12))])
    x = np.vstack([np.hstack([chain, np.zeros((5000, 12))]), apart])
    near = Pairs(frame(spark, x), 0.9999, pivots=64).between_classes()
    found = connected(spark.range(20_000).select(F.col("id").alias("node")), near).groupBy("component").count().orderBy(F.desc("count")).limit(2).collect()
    assert (found[0].component, found[0]["count"]) == (0, 5000) and found[1]["count"] < 10


def test_chains_and_circles(spark):
    links = {i: i + 1 for i in range(0, 60)} | {100: 101, 101: 102, 102: 100, 103: 101, 110: 110, 111: 110}
    nodes = [*range(61), *range(100, 104), 110, 111, 200]

    def end(i):
        seen = set()
        while i not in seen and i in links:
            seen.add(i)
            i = links[i]
        return i

    got = {r.node: r.end for r in ends(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(list(links.items()), "node long, up long")).collect()}
    assert got == {n: end(n) for n in nodes}


# --- identities


def people(spark, meetings, known=(), weights=None):
    """``meetings``: id -> (voices, attendees' names); as relations of one recording each."""
    links = [(m, m, (weights or {}).get(m, "matched"), False) for m in meetings]
    lines = [(m, v) for m, (vs, _) in meetings.items() for v in vs]
    invited = [(m, p, None) for m, (_, ps) in meetings.items() for p in ps]
    return (
        spark.createDataFrame(links, "recording_id long, meeting_id long, link_type string, is_dismissed boolean"), spark.createDataFrame(lines, "recording_id long, speaker_uuid string"),
        spark.createDataFrame(invited, "meeting_id long, name string, email string"), spark.createDataFrame(list(known), "voice string, person string"),
    )


def inferred(spark, meetings, known=(), **more):
    weights = more.pop("weights", None)
    return {r.speaker_uuid: (r.person, r.tier, round(r.score, 6), r.reason) for r in identity.infer(*people(spark, meetings, known, weights), **more).collect()}


def test_deductions_follow_from_each_other(spark):
    meetings = {1: (["me", "v1"], ["Me", "Ann"]), 2: (["v1", "v2"], ["Ann", "Bob"]), 3: (["v1", "v2", "v3"], ["Ann", "Bob", "Cy"]), 4: (["x", "y"], ["Ed", "Flo"])}
    got = inferred(spark, meetings, [("me", "me")])
    assert {k: v[:3] for k, v in got.items() if v[1] == "forced"} == {"v1": ("ann", "forced", 1.0), "v2": ("bob", "forced", 1.0), "v3": ("cy", "forced", 1.0)}
    assert got["v1"][3] == "Only unidentified person in your 1:1 with Ann" and got["v3"][3] == "Only unidentified person in a 3-person meeting"
    # Of x and y nothing is certain: they were in one meeting with the same two people.
    assert got["x"][1] == "likely" and "could also be" in got["x"][3]
    assert not inferred(spark, {}, [])


def test_guesses_are_greedy_one_to_one_and_demoted_by_rivals(spark):
    """u is in six meetings, Kim in five of them and in no other; Lee was invited to everything."""
    meetings = {i: (["u", f"w{i}"], [*(["Kim"] if i < 6 else []), "Lee", f"A{i}", f"B{i}"]) for i in range(1, 7)} | {i: ([f"z{i}", f"y{i}"], ["Lee", f"C{i}", f"D{i}"]) for i in range(10, 20)}
    got = inferred(spark, meetings)
    assert got["u"][:3] == ("lee", "likely", 1.0) and got["u"][3] == "In 6 of this voice's 6 meetings"  # rank 6 against 25/6; not exclusive, so not strong
    alone = {k: v for k, v in meetings.items() if k < 10}
    alone = {k: (vs, [p for p in ps if p != "Lee"]) for k, (vs, ps) in alone.items()}
    strong = inferred(spark, alone)["u"]
    assert strong[:3] == ("kim", "strong", round(5 / 6, 6))
    twins = {k: (vs, [*ps, "Twin"] if "Kim" in ps else ps) for k, (vs, ps) in alone.items()}
    both = inferred(spark, twins)["u"]
    assert both[:2] == ("kim", "likely") and both[3].endswith("could also be Twin")
    assert "u" not in inferred(spark, alone, rejected=spark.createDataFrame([("u",)], "speaker_uuid string"))


def test_matching_in_rounds_is_matching_one_by_one(spark):
    rng = random.Random(8)
    rows = [(f"v{i}", f"p{j}", rng.choice([0.2, 0.5, 1.0]), rng.choice([0.5, 1.0]), rng.randrange(1, 4), 4, rng.choice([0.5, 1.0, 1.5])) for i in range(25) for j in range(25) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "voice string, person string, coverage double, specificity double, shared long, total long, rank double")
    want, vs, ps = set(), set(), set()
    for v, p, _, s, n, _, r in sorted(rows, key=lambda x: (-x[6], -x[3], -x[4], x[0], x[1])):
        if v not in vs and p not in ps:
            want.add((v, p)), vs.add(v), ps.add(p)
    assert {(r.voice, r.person) for r in identity.matched(df).collect()} == want


def test_pooling_by_personas(spark):
    """One person's voice was taken for two: alone, neither has a majority of its meetings with Kim."""
    meetings = {1: (["u1", "o1"], ["Kim", "A", "B"]), 2: (["u2", "o2"], ["Kim", "C", "D"]), 3: (["u1", "o3"], ["E", "F", "G"])}
    personas = spark.createDataFrame([("u1", "u1"), ("u2", "u1")], "speaker_uuid string, persona string")
    got = inferred(spark, meetings, personas=personas)
    assert got["u1"][:3] == got["u2"][:3] == ("kim", "likely", round(2 / 3, 6))
    assert not {"u1", "u2"} & set(inferred(spark, meetings, personas=personas, least="strong"))


def test_attendees_in_either_form(spark):
    rows = [(1, '[{"name": "Ann", "email": "A@x.com"}, {"name": "Bo"}]'), (2, '["Cy", "Di"]'), (3, "not json"), (4, None), (5, "[]")]
    got = {(r.meeting_id, r.name, r.email) for r in identity.read_attendees(spark.createDataFrame(rows, "id long, attendees string")).collect()}
    assert got == {(1, "Ann", "A@x.com"), (1, "Bo", None), (2, "Cy", None), (2, "Di", None)}


def test_weights_of_links(spark):
    links, lines, invited, _ = people(spark, {1: (["v"], ["P"]), 2: (["v"], ["P"]), 3: (["v"], ["Q"])}, weights={2: "suggested", 3: "possible"})
    voices, _ = identity.contexts(links, lines, invited)
    assert {r.meeting_id: r.w for r in voices.collect()} == {1: 1.0, 2: 0.6, 3: 0.3}
    assert math.isclose({r.person: r.coverage for r in identity.candidates(*identity.contexts(links, lines, invited)).collect()}["p"], 1.6 / 1.9)
