"""Operators on a few rows of one's own, against rows worked out by hand."""

import math

import pytest

from colloquy import plans
from colloquy.domain import statement
from colloquy.operators import groups
from colloquy.plans import procedures

SCHEMAS = {
    "utterances": "id long, recording_id long, utterance_index int, start_time double, end_time double, speaker string, speaker_uuid string, text string, n_words double, is_hidden boolean, review_status string, speaker_assignment_source string, speaker_reviewed_at long, audio_source string",
    "recordings": "id long, title string, created_at long, source string, duration double, speaker_review_status string, access boolean",
    "vectors": "vec_id long, utterance_id long, recording_id long, speaker_uuid string, embedding array<double>",
    "tags": "id int, name string, mcp_hidden boolean", "recording_tags": "recording_id long, tag_id int",
    "recording_meetings": "recording_id long, meeting_id long, link_type string, is_dismissed boolean", "attendees": "meeting_id long, name string, email string",
    "tokens": "recording_id long, text string, p double", "review_signals": "recording_id long, score double, audio_exists boolean", "aliases": "id long, canonical_id long, identity_state string",
    "attendee_mappings": "speaker_uuid string, email string, source string",
}


def relations(spark, **rows):
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def line(id_, recording=1, index=0, start=0.0, end=1.0, uuid="a", text="one two", hidden=False, speaker="A", review=None, by=None, reviewed=None, track=None):
    return (id_, recording, index, float(start), float(end), speaker, uuid, text, 2.0, hidden, review, by, reviewed, track)


def recording(id_, source="recording", duration=600.0, status=None, created=1):
    return (id_, f"r{id_}", created, source, duration, status, True)


def got(spark, name, source, *columns):
    return sorted((tuple(r[c] for c in columns) for r in plans.run(spark, source, name).collect()), key=str)


def test_owner_counts_only_recordings_of_ones_own(spark):
    lines = [line(1, 1, uuid="a"), line(2, 2, uuid="a"), line(3, 3, uuid="a"), line(4, 3, uuid="b"), line(5, 4, uuid="b"), line(6, 5, uuid=None)]
    source = relations(spark, utterances=lines, recordings=[recording(1), recording(2, "imported"), recording(3), recording(4, "voiceMemos"), recording(5)])
    assert got(spark, "AGG-09", source, "speaker_uuid", "recordings", "solo") == [("a", 3, 1), ("b", 2, 1)]
    assert got(spark, "INF-04", source, "owner") == [("a",)]
    tie = relations(spark, utterances=[line(1, 1, uuid="a"), line(2, 2, uuid="b")], recordings=[recording(1), recording(2)])
    assert got(spark, "INF-04", tie, "owner") == [(None,)]
    nobody = relations(spark, utterances=[line(1, 1, uuid=None)], recordings=[recording(1)])
    assert got(spark, "INF-04", nobody, "owner") == [(None,)]


def test_status_joins_vectors_on_their_lines(spark):
    lines = [line(100), line(101, hidden=True), line(102), line(200, 2)]
    vectors = [(1, 100, 1, "a", [1.0]), (2, 101, 1, "a", [1.0]), (3, 200, 2, "a", [1.0]), (100, 999, 1, "a", [1.0]), (4, 100, 1, "a", [2.0])]
    source = relations(spark, utterances=lines, recordings=[recording(1, created=5), recording(2, created=9)], vectors=vectors, tags=[(1, "private", True)], recording_tags=[(2, 1)])
    assert got(spark, "AGG-12", source, "recordings", "newest", "lines", "indexed", "coverage") == [(1, 5, 2, 1, 0.5)]
    assert got(spark, "VEC-06", source, "recording_id", "visible", "indexed", "ratio") == [(1, 2, 1, 0.5), (None, 2, 1, 0.5)]
    empty = relations(spark, utterances=[], recordings=[], vectors=[], tags=[], recording_tags=[])
    assert got(spark, "AGG-12", empty, "recordings", "lines", "coverage") == [(0, 0, 1.0)] and got(spark, "VEC-06", empty, "recording_id", "ratio") == [(None, 1.0)]


def test_profile_counts_visible_lines(spark):
    lines = [
        line(1, uuid="a", by="manual", reviewed=1, track="microphone", review="user_kept"), line(2, uuid=None, speaker="B", by="auto", track="system"), line(3, uuid=None, speaker=" "), line(4, hidden=True, uuid="z", review="user_hidden", track="microphone"), line(5, uuid="a", by="global_manual"),
        line(9, 2, hidden=True),
    ]
    source = relations(spark, utterances=lines, vectors=[(1, 1, 1, "a", [1.0]), (2, 1, 1, "a", [1.0]), (3, 4, 1, "z", [1.0])])
    assert got(spark, "AGG-11", source, "recording_id", "visible", "speakers", "manual", "human_actions", "voices", "unassigned", "not_manual", "unreviewed", "microphone", "system_") == [(1, 4, 3, 2, 2, 1, 1, 2, 3, 1, 1)]


def test_monologues_are_by_speaker_and_start(spark):
    lines = [
        line(1, 1, 5, 0, 4, "a", "one two"), line(2, 1, 1, 4, 9, "a", "three"), line(3, 1, 2, 9, 10, "b", "x"), line(4, 1, 3, 10, 30, None, "noise"), line(5, 1, 4, 30, 34, "a", "l'été 42 ok"),
        line(6, 2, 0, 0, 5, "b", "b b"), line(7, 2, 1, 3, 4, "b", "c"), line(8, 2, 2, 5, 60, "b", "hidden", hidden=True), line(9, 3, 0, 0, 9, "a", "equal"),
    ]
    assert got(spark, "AGG-16", relations(spark, utterances=lines), "speaker_uuid", "recording_id", "seconds", "words") == [("a", 1, 9.0, 3), ("b", 2, 5.0, 3)]


def test_tokens_without_markers(spark):
    tokens = [(1, "[_BEG_]", 0.0), (1, "a", 0.5), (1, "[b]", 0.3), (1, "_c]", 0.9), (1, "d", None), (1, "[_TT_250]", 0.01), (2, "[_EOT_]", 0.9)]
    assert got(spark, "AGG-18", relations(spark, tokens=tokens), "recording_id", "mean_p", "min_p", "low_frac", "tokens") == [(1, round(1.7 / 3, 6), 0.3, round(1 / 3, 6), 3)]


def test_coverage_of_attendees(spark):
    """v is in meetings 1 (matched), 2 (suggested) and 3 (possible); p was invited to 1 and 2, q to 3 and 4, which only w is in."""
    links = [(1, 1, "matched", False), (2, 2, "suggested", False), (2, 2, "possible", False), (3, 3, "possible", False), (4, 4, "matched", False), (5, 5, "matched", True), (6, 6, "matched", False)]
    lines = [line(1, 1, uuid="v"), line(2, 2, uuid="v"), line(3, 3, uuid="v"), line(4, 4, uuid="w"), line(5, 5, uuid="v"), line(6, 6, uuid=None)]
    people = [(1, "P", "p@X.com"), (1, "P again", " P@x.com "), (2, "", "p@x.com"), (3, " Q ", None), (4, "q", ""), (4, "", None), (5, "P", "p@x.com"), (6, "P", "p@x.com")]
    source = relations(spark, recording_meetings=links, utterances=lines, attendees=people)
    assert got(spark, "INF-02", source, "voice", "person", "shared", "total", "coverage", "specificity", "rank") == [("v", "p@x.com", 2, 3, round(1.6 / 1.9, 6), 1.0, round(3.2 / 1.9, 6)), ("v", "q", 1, 3, round(0.3 / 1.9, 6), round(0.3 / 1.3, 6), round(0.3 / 1.9, 6)), ("w", "q", 1, 1, 1.0, round(1 / 1.3, 6), 1.0)]


def test_what_to_review_next(spark):
    gold = [line(i, 1, uuid="a", by="manual", reviewed=1, track="microphone") for i in (1, 2)]
    fresh = [line(10 + i, 2, uuid="ab"[i % 2], track="system") for i in range(4)]
    long = [line(100 + i, 3, uuid="a", by="manual" if i else None, reviewed=1, review="user_corrected") for i in range(4)]
    source = relations(spark, utterances=[*gold, *fresh, *long], recordings=[recording(1, status="gold"), recording(2, duration=720.0), recording(3, duration=6000.0, status="gold")], vectors=[(1, 10, 2, "a", [1.0])], review_signals=[(2, 7.0, True), (1, 50.0, True)])
    # 2: 7 + 35 + 0 voices 12/4 + two speakers 24 + no such gold 24 + system 18 + 12 minutes 22; 3: 0 - 80 + 20 + 10 + 20 * 3/4 + 8 - min(30, 55/2)
    assert got(spark, "EVL-12", source, "recording_id", "score") == [(1, -1000.0), (2, 7 + 35 + 3 + 24 + 24 + 18 + 22.0), (3, -80 + 20 + 10 + 15 + 8 - 27.5)]


def test_each_recording_against_the_others_of_its_identity(spark):
    v = lambda i, r, u, *x: (i, i, r, u, [float(y) for y in x])
    vectors = [v(1, 1, "a", 3, 0), v(2, 1, "a", 1, 0), v(3, 2, "a", 0, 5), v(4, 3, "a", 1, 1), v(5, 1, "b", 1, 0), v(6, 2, "b", 1, 0), v(7, 1, None, 1, 0), v(8, 4, "a", 0, 0)]
    h = math.sqrt(0.5)
    c = {1: (1, 0), 2: (0, 1), 3: (h, h)}
    want = []
    for r, (x, y) in c.items():
        ox, oy = (sum(c[o][k] for o in c if o != r) for k in (0, 1))
        want.append(("a", r, round((x * ox + y * oy) / math.hypot(ox, oy), 6), 3))
    assert got(spark, "EVL-13", relations(spark, vectors=vectors), "speaker_uuid", "recording_id", "similarity", "recordings") == want


def test_aliases_are_followed_to_their_end(spark):
    chain = [(i, i + 1, "alias") for i in range(1, 150)] + [(150, None, "active")]
    rows = chain + [(201, 202, "alias"), (202, 203, "alias"), (203, 202, "alias"), (204, 204, "alias"), (205, 1, "active"), (206, 999, "alias"), (207, 205, "alias")]
    found = dict((r.id, r.canonical) for r in procedures.canonical(spark, relations(spark, aliases=rows)).collect())
    assert all(found[i] == 150 for i in range(1, 151))
    # A circle ends at its first id that comes again; who is no alias stands for themselves.
    assert {k: v for k, v in found.items() if k > 200} == {201: 202, 202: 202, 203: 203, 204: 204, 205: 205, 206: 999, 207: 205}
    short = relations(spark, aliases=rows[150:])
    assert {r.id: r.canonical for r in plans.run(spark, short, "ASG-05").collect()} == {k: v for k, v in found.items() if k > 200}


def test_the_model_of_labelled_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    y = (np.arange(60) % 3 == 0).astype(float)
    x = np.column_stack([0.4 + 0.3 * y + rng.normal(size=60) * 0.1, y + rng.normal(size=60)])
    m = groups.calibrate(x, y)
    assert m.cosine_mean == pytest.approx(x[:, 0].mean()) and m.z_scale == pytest.approx(x[:, 1].std(ddof=1))
    # At the optimum the weighted gradient and the penalty cancel out.
    f = np.column_stack([np.ones(60), (x[:, 0] - m.cosine_mean) / m.cosine_scale, (x[:, 1] - m.z_mean) / m.z_scale])
    weight = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    gradient = f.T @ ((m(x[:, 0], x[:, 1]) - y) * weight) / 60 + 0.35 * np.array([0, m.cosine, m.z])
    assert np.abs(gradient).max() < 0.02 and m.cosine > 0
    assert groups.calibrate(x[:5], y[:5]) is None and groups.calibrate(x, np.zeros(60)) is None
    assert groups.probability(0.55) == pytest.approx(1 / (1 + math.exp(0.4))) and groups.probability(0.65, 2.0) == pytest.approx(1 / (1 + math.exp(-(-0.4 + 1.35 + 0.3))))
    assert groups.merge_point(None, x) == 0.88 and groups.merge_point(m, x[:0]) == 0.88
    worst = m(x[y == 0, 0], x[y == 0, 1]).max()
    assert groups.merge_point(m, x[y == 0]) == pytest.approx(min(0.985, max(0.6, worst + 0.03)))


def test_plans_see_the_relations_they_are_given(spark):
    one = relations(spark, tokens=[(1, "a", 0.5)])
    two = relations(spark, tokens=[(2, "b", 0.25)])
    first = statement(spark, one, "SELECT recording_id FROM tokens")
    second = statement(spark, two, "SELECT recording_id FROM tokens")
    assert [r[0] for r in first.collect()] == [1] and [r[0] for r in second.collect()] == [2]


def test_no_operator_makes_up_values(spark):
    """Plans on harmless lines of one's own: nothing is found that isn't in them."""
    texts = [(i, 1, i, "en", f"we spoke about plan number {i}", "A", i * 5.0, i * 5.0 + 3, None) for i in range(200)]
    mine = {"text_lines": spark.createDataFrame(texts, "id long, recording_id long, utterance_index int, lang string, text string, speaker string, start_time double, end_time double, mean_p double")}
    assert plans.run(spark, mine, "TXT-12").count() == 0
    assert plans.run(spark, mine, "TXT-15").where("outlier").count() == 0
    mine["repairs"] = spark.createDataFrame([(7, "we spoke about plan number seven"), (8, ""), (9, "<|x|> hm")], "id long, proposed string")
    assert {r.id: r.safe for r in plans.run(spark, mine, "TXT-24").collect()} == {7: True, 8: False, 9: False}


def test_operators_take_the_columns_they_are_given(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    runs = one([(1, 0, "log\n\nhello there", ""), (2, 1, "", "malloc failed"), (3, 0, "\n\n", "")], "id long, exit_code int, stdout string, stderr string")
    assert {r.id: (r.error, r.transcript) for r in plans.run(spark, {"process_runs": runs}, "SRC-08").collect()} == {1: (None, "hello there"), 2: ("memory_error", None), 3: ("unknown", None)}
    channels = one([(1, 1, 0.0, 2.0, "good morning to all", True), (2, 1, 1.0, 3.0, "good morning to all", False), (3, 1, 50.0, 52.0, "good morning to all", True)], "id long, recording_id long, start_time double, end_time double, text string, mic boolean")
    assert [r.id for r in plans.run(spark, {"channel_lines": channels}, "JN-17").collect()] == [3]
    files = one([(1, "meeting_170_mic.m4a"), (83, "memo.m4a")], "id long, file_name string")
    assert {r.id: r.stamp for r in plans.run(spark, {"recordings": files}, "TXT-26").collect()} == {1: "170", 83: ""}
    people = one([("a", "Ann Lee"), ("b", "ann.lee@example.com"), ("c", "Bo Lee"), ("d", None)], "uuid string, called string")
    assert {(r.a, r.b) for r in plans.run(spark, {"people": people}, "TXT-27").collect()} == {("a", "b")}
    heard = one([(1, "EN ", 0.5, 0.0, 4.0), (1, "fr", None, 4.0, 7.0), (1, "auto", 0.9, 7.0, 99.0)], "recording_id long, language string, confidence double, start_time double, end_time double")
    assert [(r.language, r.confidence, r.source) for r in plans.run(spark, {"heard_languages": heard}, "AGG-20").collect()] == [("en", 0.5, "audio")]
    edits = one([(1, 5.0, 5.001), (2, 5.0, 6.0), (3, None, 5.0), (4, 5.0, None)], "id long, stored double, seen double")
    assert {r.id: (r.accepted, r.current_version) for r in plans.run(spark, {"note_edits": edits}, "STR-13").collect()} == {1: (True, None), 2: (False, 5.0), 3: (False, None), 4: (True, None)}


def test_refinements_that_can_be_used_again(spark):
    """Of the same schema, file, transcription and lines: completed, or resumable from a checkpoint; else due."""
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = range(1, 10)
    given = relations(spark, recordings=[(i, "t", 0, "recording", 12.3456, None, True) for i in ids])
    given["audio_files"] = one([(i, 1000, 50.9, None if i == 7 else 60.5) for i in ids if i != 8], "recording_id long, size long, modified double, transcribed_at double")
    given["line_digests"] = one([(i, "d") for i in ids if i != 9], "recording_id long, digest string")
    same = "1000:50:12345:60500"
    kept = [(1, 2, same, "d", 9.0, False), (2, 2, same, "d", None, True), (3, 2, same, "d", None, False), (4, 1, same, "d", 9.0, True), (5, 2, "1000:51:12345:60500", "d", 9.0, True), (6, 2, same, "edited", 9.0, True), (8, 2, "0:0:12345:0", "d", 9.0, True), (9, 2, same, None, None, True)]
    given["refinements"] = one(kept, "recording_id long, schema_version int, fingerprint string, digest string, completed_at double, has_checkpoint boolean")
    got = {r.id: (r.fingerprint, r.state) for r in plans.run(spark, given, "SNK-09").collect()}
    assert got == {1: (same, "completed"), 2: (same, "resumable"), 3: (same, "due"), 4: (same, "due"), 5: (same, "due"), 6: (same, "due"), 7: ("1000:50:12345:0", "due"), 8: ("0:0:12345:0", "completed"), 9: (same, "resumable")}
