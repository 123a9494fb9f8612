"""Rules on literal cases, apart from the plans' own SQL."""

import pytest
from pyspark.sql import functions as F

from colloquy import functions, plans, sinks
from colloquy.plans import procedures
from colloquy.sources import transcripts
from colloquy.versions import Keyed


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_runs_of_words(spark):
    texts = {"": (1, False), "a b a b a b c": (3, False), "no, no. no! no": (4, False), "No. " * 12: (12, True), "one two three four five six": (1, False), "ja ja ja ja ja " + "i think " * 6: (6, True), "it is it is what we said on all of these days here": (2, False)}
    df = table(spark, "t string", *[(t,) for t in texts])
    got = {r.t: (r.run, r.loop) for r in df.select("t", functions.longest_run(F.col("t")).alias("run"), functions.runaway(F.col("t")).alias("loop")).collect()}
    assert got == texts
    # Brute force: every phase of every length.
    import random

    r = random.Random(3)
    lines = [" ".join(r.choice("ab") if r.random() < 0.8 else "c" for _ in range(r.randint(0, 14))) for _ in range(150)]

    def brute(t):
        w, best = t.split(), 1
        for n in range(1, 5):
            for o in range(n):
                run = 1
                for i in range(o + n, len(w) - n + 1, n):
                    run = run + 1 if w[i : i + n] == w[i - n : i] else 1
                    best = max(best, run)
        return best

    got = table(spark, "t string", *[(t,) for t in lines]).select("t", functions.longest_run(F.col("t")).alias("run")).collect()
    assert [x.run for x in got] == [brute(x.t) for x in got]


def test_word_distance():
    import random

    def table_of(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert functions.edit_distance(a, b) == table_of(a, b)


def test_suspicion(spark):
    good = "we talked about the plan for next week and who will do it"
    cases = [
        (good, {}, 0.0, [], "ok"), ("[Musik] ♪", {}, 1.0, ["emptyOrSymbols"], "junk"), ("Subtitles by the Amara.org community", {}, 1.0, ["boilerplate"], "junk"), ("Thank you. . . . . .", {"mean_p": 0.9}, 1.0, ["silenceFiller"], "junk"),
        ("ready to work " * 6, {}, 1.0, ["repetitionLoop"], "junk"), (good, {"mean_p": 0.3}, 0.55, ["veryLowTokenProb"], "verify"), (good, {"low_frac": 0.5}, 0.35, ["lowTokenProb"], "ok"), (good, {"end_time": 1.2}, 0.4, ["highCharRate"], "verify"), ("so it is", {"end_time": 14.0}, 0.25, ["longSparse"], "ok"),
        (good, {"voice_match": 0.1}, 0.0, [], "ok"), (good, {"mean_p": 0.5, "voice_match": 0.1}, 0.65, ["lowTokenProb", "voiceMismatch"], "verify"), ("thank you", {"exemplar_exact": True, "end_time": 10.0}, 0.5, ["knownHallucination"], "verify"), (good, {"exemplar_exact": True}, 0.0, [], "ok"),
    ]
    base = {"start_time": 0.0, "end_time": 5.0, "speaker": "A", "mean_p": None, "low_frac": None, "exemplar_exact": False, "exemplar_overlap": None, "exemplar_cosine": None, "voice_match": None, "neighbour_cosine": None}
    schema = "id long, recording_id long, utterance_index int, text string, start_time double, end_time double, speaker string, mean_p double, low_frac double, exemplar_exact boolean, exemplar_overlap double, exemplar_cosine double, voice_match double, neighbour_cosine double"
    rows = [(i, i, 0, t, *(base | more).values()) for i, (t, more, *_) in enumerate(cases)]
    # Lines that say the same: a pair counts if it is long enough, the third always.
    rows += [(100 + i, 99, i, "we said this before", *base.values()) for i in range(3)] + [(110 + i, 98, i, "yes", *base.values()) for i in range(3)]
    got = {r.id: r for r in procedures.suspicion(table(spark, schema, *rows)).collect()}
    for i, (_, _, score, reasons, tier) in enumerate(cases):
        assert (got[i].score, got[i].reasons, got[i].tier) == (pytest.approx(score), reasons, tier), cases[i]
    assert [got[i].score for i in (100, 101, 102, 110, 111, 112)] == [0.0, 0.5, 0.85, 0.0, 0.0, 0.85]


def test_meetings_near_a_recording(spark):
    hour = 3600
    rec = table(spark, "id long, created_at long, duration double", (1, 100 * hour, 3600.0))
    at = lambda i, a, b: (i, f"cal-{i}", int(100 * hour + a), int(100 * hour + b))
    meet = table(spark, "id long, calendar_event_id string, start_at long, end_at long", at(1, 3600 + 300, 5000), at(2, 3600 + 301, 5000), at(3, 3600 + 2700, 9000), at(4, 3600 + 2701, 9000), at(5, 3600 + 43200, 60000), at(6, 3600 + 43201, 60000), at(7, -9000, -300))
    got = {r.meeting_id: r.tier for r in plans.run(spark, {"recordings": rec, "meetings": meet}, "JN-11").collect()}
    assert got == {1: "matched", 2: "suggested", 3: "suggested", 4: "possible", 5: "possible", 7: "matched"}
    soon = plans.run(spark, {"meetings": meet}, "FIL-16", now=100 * hour + 3600 + 200, lead=120, prompted=("cal-2",)).collect()
    assert [(r.id, r.seconds) for r in soon] == [(1, 100)]


def test_readers_of_whole_and_of_broken_output(spark):
    raw = table(spark, "recording_id long, json string", (1, '{"schema_version":1,"segments":[{"start":0,"end":2,"speaker":"0","text":" a "},{"Start":2,"End":9,"Speaker":1,"Content":"b"},{"start":3,"end":3,"speaker":"0","text":"x"}]}'), (2, "```json\n[{\"start\":1,\"end\":2,\"speaker\":\"A\",\"text\":\"c\"}]\n```"), (3, '{"schema_version":9,"segments":[]}'), (4, '[{"start":1,'), (5, "[]"))
    got = sorted((r.recording_id, r.start_time, r.end_time, r.speaker, r.text, r.problem) for r in transcripts.diarised(raw.withColumn("duration", F.lit(5.0)), duration="duration").collect())
    assert got[:3] == [(1, 0.0, 2.0, "Speaker 0", "a", None), (1, 2.0, 5.0, "Speaker 1", "b", None), (2, 1.0, 2.0, "Speaker A", "c", None)]
    assert [(r[0], r[-1]) for r in got[3:]] == [(3, "newer than is understood"), (4, "not whole"), (5, "no segments")]
    broken = table(spark, "recording_id long, json string", (1, '```json\n[{"Start time":"1:02.5","End time":"01:00:00","Speaker ID":"x","Content":"with {braces} and \\"}\\""}, {"start":"12.5s","end":13,"text":"k","more":{"a":{"b":1}}}, {"start":true,"end":5,"text":"t"}, {"start":1,"end":2,"text":" "}, {"start":7,"en'))
    assert sorted((r.start_time, r.end_time, r.speaker, r.text) for r in transcripts.segments(broken).collect()) == [(12.5, 13.0, "unknown", "k"), (62.5, 3600.0, "x", 'with {braces} and "}"')]


def test_sinks(spark, tmp_path):
    rec = table(spark, "file_name string, created_at long, duration double, language string, status string, error string, transcript string", ("a.m4a", 1, 2.0, "en", "Completed", None, 'he said "no"\nand left')).coalesce(1)
    for kind in sinks.EXPORTS:
        sinks.export(rec, str(tmp_path / kind), kind)
    lines = (tmp_path / "csv").glob("part*.csv").__next__().read_text().splitlines()
    assert lines[0].replace('"', "") == "File Name,Date,Duration,Language,Status,Error,Transcript" and lines[1].endswith('"he said ""no"" and left"')
    assert "Transcript:\nhe said" in next((tmp_path / "txt").glob("part*")).read_text()
    path = str(tmp_path / "lines")
    table(spark, "id long, text string, recording_id long", (1, "a", 1), (2, "b", 1), (3, "c", 2)).write.partitionBy("recording_id").parquet(path)
    sinks.replace_recordings(table(spark, "id long, text string, recording_id long", (9, "new", 1)), path)
    assert sorted((r.id, r.recording_id) for r in spark.read.parquet(path).collect()) == [(3, 2), (9, 1)]
    first = sinks.upsert(spark, str(tmp_path / "u"), table(spark, "k long, v string, at int", (1, "a", 1), (1, "b", 2)), ["k"], "at", 1)
    assert [(r.k, r.v) for r in first.collect()] == [(1, "b")]
    second = sinks.upsert(spark, str(tmp_path / "u"), table(spark, "k long, v string, at int", (1, "late", 1), (2, "c", 3)), ["k"], "at", 2)
    assert sorted((r.k, r.v) for r in second.collect()) == [(1, "b"), (2, "c")]


def test_index_takes_late_and_repeated_changes(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "id long, text string, is_hidden boolean, version int"
    batches = [[(1, "a", False, 1), (2, "b", False, 5)], [(1, "a3", True, 3)], [(1, "a2", False, 2), (2, "b", False, 5)], [(3, "c", False, 1)]]
    kept = Keyed(spark, f"file://{path}", ["id"])
    for rows in [*batches, batches[0]]:
        kept.upsert(table(spark, schema, *rows), "version")
    assert sorted((r.id, r.text) for r in kept.read().where("NOT is_hidden").collect()) == [(2, "b"), (3, "c")]
