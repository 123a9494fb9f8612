"""Ordered folds and group decisions on small cases."""

import itertools
import tracemalloc

import numpy as np
import pytest

from colloquy.operators import folds, groups


def hit(i, index, start, score=0.01):
    return {"recording_id": 1, "id": i, "utterance_index": index, "start_time": float(start), "score": score}


def test_moments_are_anchored_on_their_first_hit():
    got = list(folds.moments([hit(1, 0, 0), hit(2, 2, 15), hit(3, 4, 30)]))
    assert [m["members"] for m in got] == [[1, 2], [3]]
    assert len(list(folds.moments([hit(10, 1, 0), hit(11, 50, 0)]))) == 2
    best = folds.moments([hit(10, 1, 10, 0.02), hit(11, 2, 15, 0.03), hit(12, 10, 100)])
    assert [(m["id"], m["members"]) for m in best] == [(11, [11, 10]), (12, [12])]


def test_stitching_and_collapsing():
    rows = [{"recording_id": 1, "id": i, "text": t} for i, t in enumerate(["we start the meeting now", "meeting now with all", "a", "a b"])]
    assert [r["added"] for r in folds.stitch(rows)] == ["we start the meeting now", "with all", "a", "a b"]
    line = lambda i, a, t: {"recording_id": 1, "id": i, "start_time": a, "end_time": a + 1, "text": t}
    assert [r["id"] for r in folds.collapse([line(1, 0.0, "Hi"), line(2, 0.1, "hi"), line(3, 0.2, "hi"), line(4, 0.1, "ho")])] == [1, 3, 4]


def test_claims_are_one_to_one_in_order():
    line = lambda i, a: {"recording_id": 1, "id": i, "start_time": a, "end_time": a + 1, "text": "same"}
    decide = lambda i, a: line(i, a) | {"decides": True}
    got = list(folds.claim([line(7, 11.5) | {"decides": False}, line(8, 40.0) | {"decides": False}, decide(1, 10.0), decide(2, 10.0), decide(3, 500.0)]))
    assert [(r["decision"], r["line"]) for r in got] == [(1, 7), (2, 8)]


def test_exemplars_forget():
    row = lambda t, learn, s="user": {"text": t, "learn": learn, "source": s}
    assert list(folds.exemplars([row("x", True, "detector"), row("x", False), row("x", True, "verifier"), row("x", True)])) == [{"text": "x", "occurrences": 2, "source": "user"}]
    assert not list(folds.exemplars([row("x", True), row("x", False)])) and not list(folds.exemplars([row("a b c d e f g h i", True)]))


def test_conversations_are_scored_by_three_moments_and_the_title():
    def at(rec, i, index, start, score, field="transcript"):
        return {"recording_id": rec, "id": i, "utterance_index": index, "start_time": float(start), "score": score, "field": field}

    one = next(folds.conversation([at(2, 20, 1, 0, 0.028), at(2, 21, 20, 120, 0.009)]))
    assert abs(one["score"] - 0.0298) < 1e-9 and one["moments"] == 2 and not one["title_only"]
    two = next(folds.conversation([at(1, 10, 1, 0, 0.02), at(1, -1, -1, 0, 0.5, "title")]))
    assert abs(two["score"] - 0.022) < 1e-9
    alone = next(folds.conversation([at(2, -1, -1, 0, 0.8, "title")]))
    assert alone["title_only"] and alone["score"] == 0.8


def test_policies_of_the_merge():
    def line(i, a, b, text="words and more", speaker="A", context=""):
        return {"recording_id": 1, "utterance_index": i, "speaker": speaker, "start_time": a, "end_time": b, "n_words": len(text.split()), "text": text, "context": context}

    rows = [line(0, 0.0, 2.0), line(1, 2.9, 5.0), line(2, 5.1, 8.0, speaker="B"), line(3, 8.2, 9.0, speaker="B", context="x")]
    count = lambda p: [r["lines"] for r in folds.merge_segments(rows, p)]
    assert count("legacy") == [2, 2] and count("readable") == [2, 1, 1] and count("safe") == [1, 1, 1, 1]
    long = [line(i, i * 20.0, i * 20.0 + 19.5, "it ends here." if i == 1 else "it goes on") for i in range(4)]
    assert [r["lines"] for r in folds.merge_segments(long, "readable")] == [2, 2]  # after 25 s a sentence's end divides
    assert [r["lines"] for r in folds.merge_segments(long, "legacy")] == [4]


def test_ends_are_matched_once():
    assert folds.match_ends([1.0, 2.0, 9.0], [1.2, 2.9, 9.5]) == 2 and folds.match_ends([1.0, 1.1], [1.05]) == 1


def test_voice_has_hysteresis():
    quiet, loud = (0.0005, 0.002), (0.02, 0.05)
    blocks = [quiet] * 5 + [loud] * 6 + [quiet] * 4 + [loud] * 2 + [quiet] * 25
    assert folds.detect_voice(blocks) == [(8, True), (34, False)]
    assert folds.detect_voice([(0.02, 0.005)] * 10) == []  # no peak
    assert folds.detect_voice([loud] * 3 + [quiet] + [loud] * 3) == []
    # The floor is learned while nobody speaks, and holds the threshold within its bounds.
    assert folds.detect_voice([(0.0024, 0.01)] * 200) == [] and folds.detect_voice([(0.0049, 0.01)] * 4) == [(3, True)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = map(int, rng.integers(1, 5, 2))
        s = rng.random((n, m))
        best = max(sum(s[i, p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(m + n), n))
        assert abs(sum(s[i, j] for i, j in groups.hungarian(s)) - best) < 1e-9


def angles(*degrees):
    return np.array([[np.cos(np.radians(a)), np.sin(np.radians(a))] for a in degrees])


def nodes(*of, **more):
    return [{"recording_id": r, "embedding": angles(a)[0], "spans": [], "reliable": True} | more for r, a in of]


def test_constraints_win_over_similarity():
    assert groups.evidence_graph(nodes((1, 0), (2, 5), (1, 65), (2, 70)), 0.50, 0.20) == [0, 0, 2, 2]
    two = nodes((1, 0), (2, 0))
    assert groups.evidence_graph(two) == [0, 0] and groups.reconcile(two) == [0, 0]
    assert groups.reconcile(two, cannot=[(0, 1)]) == [0, 1]
    assert groups.reconcile(two, anchors={0: "person-a", 1: "person-b"}) == [0, 1]
    assert groups.evidence_graph([x | {"reliable": False} for x in two]) == [0, 1]
    # A single pair must be exceptional, and each the other's nearest by a margin.
    assert groups.evidence_graph(nodes((1, 0), (2, 45)), 0.65) == [0, 1]
    assert groups.reconcile(nodes((1, 0), (2, 80)), must=[(0, 1)]) == [0, 0]
    # Who speaks at the same time isn't one person.
    a, b, c = nodes((1, 0), (2, 1), (1, 2))
    a["spans"], c["spans"] = [(0.0, 2.0)], [(1.0, 3.0)]
    got = groups.evidence_graph([a, b, c])
    assert got[0] != got[2]


def test_margins_floors_and_second_passes_of_assignment():
    s = np.array([[0.9, 0.88], [0.2, 0.95]])
    assert groups.optimal(s, 0.85) == [(0, 0), (1, 1)] and groups.optimal(s, 0.85, 0.05) == [(1, 1)]
    known = [{"uuid": "a", "mean": angles(0)[0], "prototypes": list(angles(0, 3, 5))}, {"uuid": "b", "mean": angles(90)[0], "prototypes": [angles(90)[0]]}]
    new = [{"embedding": angles(d)[0], "spans": [(t, t + 1)], "reliable": True} for d, t in ((1, 0), (4, 5), (91, 9), (45, 20))]
    assert groups.consensus(new, known) == ["a", "a", "b", None]
    new[1]["spans"] = [(0.2, 0.9)]  # at once with the first
    assert groups.consensus(new, known)[:2].count("a") == 1
    assert groups.consensus([new[0] | {"reliable": False}], known) == [None] and groups.consensus(new, []) == [None] * 4


def test_fragments_go_to_those_who_are_known_well():
    def who(uuid, prototypes, name=None, manual=False):
        p = list(angles(*prototypes))
        return {"uuid": uuid, "name": name, "manual": manual, "prototypes": p, "mean": np.mean(p, axis=0), "occurrences": {}}

    big, far = who("big", (0, 2, 4)), who("far", (80, 82, 84))
    assert groups.consolidation(who("bit", (1,)), [big, far])["target"] == "big"
    assert groups.consolidation(who("bit", (1,)), [who("two", (0, 2))]) is None  # a target has three prototypes
    assert groups.consolidation(who("many", (0, 1, 2)), [big]) is None  # not a fragment
    assert groups.consolidation(who("many", (0, 1, 2), "Ann", True), [who("x", (0, 2, 4), "ann ", True)])["target"] == "x"
    assert groups.consolidation(who("bit", (1,), "Bo", True), [who("x", (0, 2, 4), "Ann", True)]) is None
    assert groups.consolidation(who("bit", (1,)), [big, who("twin", (1, 2, 3))]) is None  # no margin


def test_pairs_to_review():
    s = lambda i, r, u, a, mixed=False: {"id": i, "recording_id": r, "uuid": u, "embedding": angles(a)[0], "mixed": mixed}
    got = groups.review_pairs([s(1, 1, "a", 0), s(2, 2, "a", 2), s(3, 3, "a", 60), s(4, 4, "b", 61), s(5, 5, "c", 5, True)])
    assert any(x["reason"] == "varies" and 3 in (x["a"], x["b"]) and abs(x["points"] - (92 + 130 * (0.72 - np.cos(np.radians(58))))) < 1e-6 for x in got) and all(5 not in (x["a"], x["b"]) for x in got)
    assert any(x["reason"] == "confusable" and (x["a"], x["b"]) == (3, 4) for x in got)
    assert [x["points"] for x in got] == sorted((x["points"] for x in got), reverse=True)
    assert max(sum(i in (x["a"], x["b"]) for x in got) for i in range(1, 5)) <= 3
    assert groups.review_pairs([s(1, 1, "a", 0)], limit=0) == []


def test_diarisation_is_scored_under_the_best_mapping():
    seg = lambda s, a, b, n=10: {"speaker": s, "start_time": float(a), "end_time": float(b), "n_words": n}
    ref = [seg("A", 0, 10), seg("B", 10, 20)]
    same = groups.diarisation(ref, [seg("1", 0, 10), seg("2", 10, 20)])
    assert same["missed"] == same["false_alarm"] == same["confused"] == same["word_errors"] == same["mixed"] == 0 and same["seconds"] == 20
    late = groups.diarisation(ref, [seg("1", 0, 12), seg("2", 12, 22)])
    assert (late["missed"], late["false_alarm"], late["confused"], late["mixed"]) == (0, 2, 2, 1)
    one = groups.diarisation(ref, [seg("1", 0, 20)])
    assert one["confused"] == 10 and one["word_errors"] == 10 and one["predicted_speakers"] == 1


def test_clusters_and_identities():
    x = angles(0, 10, 20, 90, 95)
    assert groups.single_linkage(x, 0.98) == [0, 0, 0, 3, 3]
    assert groups.linkage(x, 0.98) == [0, 0, 2, 3, 3] or groups.linkage(x, 0.98) == [0, 1, 1, 3, 3]
    assert groups.dbscan(x, 0.02, 2) == [0, 0, 0, 3, 3]
    assert groups.mixture(np.vstack([angles(0, 1, 2), angles(90, 91, 92)])) and not groups.mixture(angles(0, 1, 2, 3, 4, 5))


# --- folds as they run: row by row, with the memory of a decision


def lines_of(n):
    """A long recording: lines of a second, pauses here and there, speakers in turn, texts that repeat."""
    for i in range(n):
        a = i * 1.2 + (i // 50) * 3
        yield {"recording_id": 1, "id": i, "utterance_index": i, "start_time": a, "end_time": a + 1, "at": a + 1, "speaker": "AB"[i // 7 % 2], "n_words": 3, "text": f"word{i % 11} and more.", "context": "", "score": (i * 37 % 100) / 100, "a": i % 500, "b": (i * 7 + 1) % 500, "embedding": [1.0, i % 3, 2.0], "speaker_uuid": "u", "learn": i % 3 > 0, "source": "user"}


FOLDS = {
    "merge": folds.merge_segments, "spans": folds.spans, "windows": folds.target_windows, "sentences": folds.pack_sentences, "stitch": folds.stitch, "splits": folds.split_points, "packed": folds.pack_spans, "collapse": folds.collapse,
    "moments": folds.moments, "ema": folds.ema, "exemplars": folds.exemplars, "pairs": folds.capped_pairs,
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_memory_does_not_grow_with_a_recording(name):
    def peak(n):
        tracemalloc.start()
        for _ in FOLDS[name](lines_of(n)):
            pass
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(100)
    assert peak(20_000) < peak(2_000) + 30_000


def test_a_recording_of_a_million_lines(spark):
    n = 1_000_000
    u = spark.range(n, numPartitions=4).selectExpr("1L AS recording_id", "id AS utterance_index", "CASE WHEN id div 5 % 2 = 0 THEN 'A' ELSE 'B' END AS speaker", "id * 1.0D AS start_time", "id * 1.0D + 0.9 AS end_time", "2.0D AS n_words", "'two words' AS text", "'' AS context")
    got = folds.per_recording(u, lambda rows: folds.merge_segments(rows, "readable"), "recording_id long, policy string, speaker string, start_time double, end_time double, words double, lines long, text string", ["utterance_index"])
    assert got.selectExpr("count(*) AS n", "sum(lines) AS lines", "max(lines) AS most").first() == (n // 5, n, 5)


def test_batches_and_recordings_are_told_apart(spark):
    rows = [(r, i, float(i), i + 0.5) for r in range(40) for i in range(0, 60, 1 + r % 3)]
    df = spark.createDataFrame(rows, "recording_id long, id long, start_time double, end_time double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = folds.per_recording(df, folds.spans, "recording_id long, a double, b double, lines long, clamped boolean", ["start_time"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for r in range(40):
        want += list(folds.spans({"recording_id": x[0], "start_time": x[2], "end_time": x[3]} for x in rows if x[0] == r))
    key = lambda r: (r["recording_id"], r["a"])
    assert sorted((tuple(r[c] for c in ("recording_id", "a", "b", "lines", "clamped")) for r in got)) == [tuple(r[c] for c in ("recording_id", "a", "b", "lines", "clamped")) for r in sorted(want, key=key)]


def at(*spans):
    return [{"recording_id": 1, "start_time": float(a), "end_time": float(b)} for a, b in spans]


def shown(rows):
    return [(round(r["a"], 6), round(r["b"], 6)) for r in rows]


def test_spans_to_listen_to_again():
    got = list(folds.spans(at((10, 12), (13, 15), (18, 19), (50, 90))))
    assert shown(got) == [(9, 16), (17, 20), (49, 75)] and [r["lines"] for r in got] == [2, 1, 1] and [r["clamped"] for r in got] == [False, False, True]
    assert [r["lines"] for r in folds.spans(at(*[(i, i + 0.5) for i in range(8)]))] == [6, 2]
    assert not list(folds.spans([]))


def test_target_windows_are_split_merged_grouped_and_padded():
    # 0-30 is split at 12 and 24; the rest of 6 s takes the neighbour at 31; 100 stands alone and is padded to at least 8 s.
    assert shown(folds.target_windows(at((0, 30), (31, 33), (100, 101)))) == [(0, 16), (8, 28), (20, 37), (96, 105)]
    # Parts of a long target come before rows that begin within it, in order.
    assert list(folds.in_parts(at((0, 30), (5, 6), (13, 40)), 12.0)) == [(0, 12), (5, 6), (12, 24), (13, 25), (24, 30), (25, 37), (37, 40)]
    assert shown(folds.target_windows(at((0, 1), (2, 3), (11, 13)))) == [(0, 7), (7, 17)]


def test_sentences_are_packed_below_fifty_words():
    row = lambda text: [{"recording_id": 1, "id": 1, "text": text}]
    ten = " ".join(["w"] * 9 + ["w."])
    assert [len(r["text"].split()) for r in folds.pack_sentences(row(" ".join([ten] * 6)))] == [40, 20]
    assert [len(r["text"].split()) for r in folds.pack_sentences(row("w " * 230))] == [100, 100, 30]
    assert [r["text"] for r in folds.pack_sentences(row("One. Two!\nThree"))] == ["One. Two! Three"] and not list(folds.pack_sentences(row("")))


def test_split_points():
    silent = lambda *ends: [{"recording_id": 1, "at": float(x), "end_time": float(x)} for x in ends]
    assert [r["at"] for r in folds.split_points(silent(10, 59, 61, 100, 130, 140))] == [61, 130]
    assert [r["at"] for r in folds.split_points(silent(10, 61, 62, 400))] == [61, 400]
    assert [r["at"] for r in folds.split_points([{"recording_id": 1, "at": 70.0, "end_time": 300.0}])] == [70, 185]


def test_packed_spans_are_bounded_and_split_hard():
    assert shown(folds.pack_spans(at((5, 6), (7, 20), (21, 40)))) == [(4, 21), (20, 41)]
    assert shown(folds.pack_spans(at((0, 60)))) == [(0, 28.5), (26.5, 56), (54, 61)]


def test_a_moving_average_of_voices():
    rows = [{"speaker_uuid": "u", "embedding": e} for e in ([2.0, 0.0], [0.0, 1.0], [0.0, 0.0])]
    got = next(folds.ema(rows))
    v = np.array([1.0, 0.0])
    for x in ([0.0, 1.0], [0.0, 0.0]):
        v = 0.9 * v + 0.1 * np.array(x)
        v /= np.linalg.norm(v)
    assert got["n"] == 3 and np.allclose(got["embedding"], v)


def test_claims_near_many_lines():
    rows = [{"recording_id": 1, "id": i, "start_time": i * 1.0, "end_time": i + 0.5, "decides": False} for i in range(200)]
    asks = [{"recording_id": 1, "id": 900 + k, "start_time": 100.0, "end_time": 100.5, "decides": True} for k in range(4)]
    assert [r["line"] for r in folds.claim([*rows, *asks])] == [100, 99, 101, 98]
    assert not list(folds.claim([{"recording_id": 1, "id": 1, "start_time": 900.0, "end_time": 901.0, "decides": True}]))
