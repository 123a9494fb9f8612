import pytest

from colloquy import api


def test_routing():
    def broken():
        raise api.SearchUnavailable("lane failed")

    run = lambda mode, ready, hybrid=lambda: "h", **k: api.route(mode, ready, lambda: "k", lambda: "s", hybrid, **k)
    assert run("hybrid", True) == ("hybrid", "h", None) and run("semantic", True)[1] == "s"
    assert run("hybrid", False)[0] == "keyword" and run("hybrid", False)[2]
    assert run("hybrid", True, broken)[:2] == ("keyword", "k")
    with pytest.raises(api.SearchUnavailable):
        run("semantic", False)
    with pytest.raises(api.SearchUnavailable):
        run("hybrid", False, fallback=False)
    assert [api.candidate_limit(n) for n in (1, 20, 400)] == [50, 60, 500]


def test_reads(spark, sf_dir):
    lib = api.Library(spark, sf_dir)
    first = lib.recordings(limit=5).collect()
    rest = lib.recordings(limit=5, before=(first[-1].created_at, first[-1].id)).collect()
    assert len(first) == 5 and not {r.id for r in first} & {r.id for r in rest}
    assert lib.recording(first[0].id).count() > 0 and lib.status().count() == 1 and lib.tags().count() == 9
    assert lib.recordings(100, scope=api.Scope(sources=("imported",), has_transcript=False)).count() == 27  # of 40, without those that a tag hides
    assert lib.recordings(100, scope=api.Scope(text="it's a \\ 100%_'\"")).count() == 0  # any text is only text


SCHEMAS = {
    "utterances": "id long, recording_id long, utterance_index int, start_time double, end_time double, speaker string, speaker_uuid string, text string, n_words double, is_hidden boolean, review_status string, suspicion double, mean_p double",
    "recordings": "id long, title string, file_name string, file_path string, external_id string, duration double, language string, created_at long, source string, full_transcript string, access boolean",
    "tags": "id int, name string, mcp_hidden boolean", "recording_tags": "recording_id long, tag_id int", "speakers": "uuid string, name string, name_source string, identity_state string", "comments": "id long, recording_id long, body string, status string, created_by string, idempotency_key string",
    "vectors": "vec_id long, utterance_id long, recording_id long, speaker_uuid string, label int, embedding array<double>", "meetings": "id long, calendar_event_id string", "recording_meetings": "recording_id long, meeting_id long, is_dismissed boolean",
}


@pytest.fixture
def library(spark):
    """Two recordings and four lines, one of them hidden."""
    lines = [(10, 1, 0, 0.0, 3.0, "A", "speaker-a", "customer launch date confirmed", False), (11, 2, 0, 0.0, 3.0, "B", "speaker-b", "launch update for the customer", False), (12, 2, 1, 3.0, 6.0, "B", "speaker-b", "secret customer launch issue", True), (13, 2, 2, 6.0, 9.0, "A", "speaker-a", "customer follow up", False)]
    rows = {
        "utterances": [(i, r, x, a, b, s, u, t, float(len(t.split())), h, None, 0.0, None) for i, r, x, a, b, s, u, t, h in lines],
        "recordings": [(1, "Launch Planning", "launch.m4a", None, "rec_1", None, None, 100, "recording", None, True), (2, "Weekly Sync", "sync.m4a", None, "rec_2", None, None, 200, "recording", None, True)],
        "tags": [(1, "Private", True), (2, "Work", False)], "recording_tags": [(1, 2)], "speakers": [("speaker-a", "Ann", None, None)], "comments": [(1, 1, "done", "open", "ann", "k1")],
        "vectors": [(1, 10, 1, "speaker-a", 0, [1.0, 0.0]), (2, 11, 2, "speaker-b", 0, [0.9, 0.1]), (3, 12, 2, "speaker-b", 0, [1.0, 0.01]), (4, 13, 2, "speaker-a", 0, [0.0, 1.0])], "meetings": [(1, "cal-1")], "recording_meetings": [(1, 1, False)],
    }
    return lambda **more: api.Library(spark, {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}, **more)


def test_words_are_found_in_tiers(library):
    lib = library()
    hits = lib.search("customer launch", "keyword").hits.orderBy("place").collect()
    assert hits[0].utterance_id == 10 and hits[0].tier == 3
    assert 11 in [h.utterance_id for h in hits] and 12 not in [h.utterance_id for h in hits]
    loose = lib.search("customer nonexistent", "keyword").hits.collect()
    assert loose and all(h.tier == 1 for h in loose)
    mine = lib.search("launch", "keyword", scope=api.Scope(speakers=("speaker-b",))).hits.collect()
    assert [h.utterance_id for h in mine] == [11] and all(h.field == "transcript" for h in mine)
    titles = [h.identity for h in lib.search("LAÚNCH planning", "keyword").hits.collect()]
    assert titles[0] == "recording:1:title"
    near = lib.search("follow up", "keyword", context=2).hits.where("utterance_id = 13").first()
    assert near.before == [11] and near.after == []
    for bad in (lambda: lib.search(" "), lambda: lib.search("..."), lambda: lib.search("x", limit=0)):
        with pytest.raises(ValueError):
            bad()
    assert lib.search("it's \\ ' \" %", "keyword").hits.count() == 0


def test_lanes_are_fused_by_rank(spark, library):
    lane = lambda *ids: lambda *_: spark.createDataFrame([(n + 1, f"utterance:{i}", 1 if i == 10 else 2, i) for n, i in enumerate(ids)], "place int, identity string, recording_id long, utterance_id long")
    lib = library(ready=True, lanes={"keyword": lane(10, 11), "semantic": lane(11, 13)})
    found = lib.search("anything", "hybrid", vector=[1.0, 0.0])
    hits = found.hits.orderBy("place").collect()
    assert [h.utterance_id for h in hits] == [11, 10, 13] and hits[0].match == "hybrid" and (hits[0].keyword_rank, hits[0].semantic_rank) == (2, 1)
    assert abs(hits[0].score - (1 / 62 + 1 / 61)) < 1e-8
    alone = lib.search("anything", "keyword").hits.orderBy("place").collect()
    assert [h.utterance_id for h in alone] == [10, 11] and alone[0].score > alone[1].score

    def broken(*_):
        raise api.SearchUnavailable("the lane failed")

    lib = library(ready=True, lanes={"keyword": lane(10, 11), "semantic": broken})
    found = lib.search("anything", "hybrid", vector=[1.0, 0.0])
    assert found.mode == "keyword" and found.note == "the lane failed"
    assert library(ready=False).search("launch", "hybrid", like=1).mode == "keyword"
    with pytest.raises(api.SearchUnavailable):
        library(ready=False).search("launch", "semantic", like=1)


def test_vectors_exact_and_approximate(library):
    lib = library()
    exact = lib.search("launch", "semantic", vector=[1.0, 0.0]).hits.orderBy("place").collect()
    assert [h.utterance_id for h in exact] == [10, 11, 13] and exact[0].relevance == 1.0 and exact[2].relevance == 0.5
    near = lib.search("launch", "ann", vector=[1.0, 0.0])
    assert near.mode == "ann" and near.complete and near.hits.orderBy("place").first().utterance_id == 10


def test_privacy(spark, library):
    lib = library()
    assert [r.id for r in lib.recordings().collect()] == [2, 1]
    lib.put("recording_tags", lib.set_tags(1, ("private",)))
    assert [r.id for r in lib.recordings().collect()] == [2] and lib.recording(1).count() == 0 and lib.meeting_notes(1).count() == 0
    assert [h.utterance_id for h in lib.search("confirmed", "keyword").hits.collect()] == []


def test_writes_and_conflicts(spark, library):
    lib = library()
    assert {r.id: r.title for r in lib.set_title(1, " New ").collect()} == {1: "New", 2: "Weekly Sync"}
    assert lib.add_comment(1, " done ", "ann", "k1")[0] == 1  # the same again
    with pytest.raises(api.Conflict):
        lib.add_comment(1, "other", "ann", "k1")
    new, table = lib.add_comment(2, "look", "bo", "k1")
    assert new == 2 and table.count() == 2
    assert lib.set_comment(1, status="resolved").first().status == "resolved" and lib.delete_comment(1).count() == 0
    with pytest.raises(ValueError):
        lib.set_comment(1, status="closed")
    notes = spark.createDataFrame([("cal-1", "a", "b", 5.0)], "calendar_event_id string, agenda string, notes string, updated_at double")
    assert lib.write_notes(notes, "cal-1", "x", "y", 6.0, seen=5.001).first().agenda == "x"
    for seen, event in ((4.0, "cal-1"), (5.0, "cal-2")):
        with pytest.raises(api.Conflict):
            lib.write_notes(notes, event, "x", "y", 6.0, seen=seen)
