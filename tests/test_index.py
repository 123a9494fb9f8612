import math
import random
from collections import defaultdict

import numpy as np
import pytest
import regex

from colloquy import api, plans
from colloquy.dialect import SPARK, folded
from colloquy.index import CHANGES, KeywordIndex
from colloquy.plans import procedures, search
from colloquy.vectors import VectorIndex
from colloquy.versions import Conflict, Keyed, Versions


def doc(id_, text, version=1, visible=True, field="transcript", recording=1):
    return (field, id_, version, visible, recording, id_ % 100, f"spk{id_ % 3}", text)


def rows(df):
    return sorted((r.term, r.field, r.doc, r.len, tuple(r.places)) for r in df.collect())


def everything(index):
    """All postings and statistics of an index."""
    found = {(r.field, r.term): (r.df, r.tf, r.first_place) for r in index.vocabulary().collect()}
    terms = sorted({t for _, t in found})
    return found, rows(index.postings(terms)) if terms else [], sorted(tuple(r) for r in index.corpus().collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = "launch customer plan the the the review Über naïve ŁÓDŹ x1 42".split()
    return [doc(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), recording=i // 10, visible=i % 9 != 0) for i in range(300)] + [doc(i, f"title {i} launch", field="title") for i in range(20)]


def test_postings_are_those_of_the_texts(spark, tmp_path, texts):
    index = KeywordIndex.build(spark, f"file://{tmp_path}/i", spark.createDataFrame(texts, CHANGES))
    want = defaultdict(list)
    for field, id_, _, visible, *_, text in texts:
        ws = regex.findall(r"[\p{L}\p{N}]+", folded(text)) if visible else []
        for place, w in enumerate(ws):
            want[w, field, id_, len(ws)].append(place)
    asked = ["the", "launch", "lodz", "łodz", "uber", "absent"]
    assert rows(index.postings(asked)) == sorted((*k, tuple(v)) for k, v in want.items() if k[0] in asked)
    n = defaultdict(list)
    for field, _, _, visible, *_, text in texts:
        if visible:
            n[field].append(len(regex.findall(r"[\p{L}\p{N}]+", folded(text))))
    assert {r.field: (r.n, r.mean) for r in index.corpus().collect()} == {k: (len(v), sum(v) / len(v)) for k, v in n.items()}


def test_a_search_reads_the_buckets_of_its_words_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("colloquy.index.LEAST", 32)
    docs = [doc(i, f"word{i} word{i + 1} common") for i in range(2000)]
    index = KeywordIndex.build(spark, f"file://{tmp_path}/i", spark.createDataFrame(docs, CHANGES))
    manifest = index.log.manifest()
    df = index.postings(["word7", "word1500"])
    files = df.inputFiles()
    of = {f"bucket={b}" for b in index.buckets(["word7", "word1500"], manifest)}
    assert len(of) <= 2 and {f.rsplit("/", 2)[1] for f in files} == of
    every = index.log.read(manifest, "postings").count()
    read = index.log.read(manifest, "postings", index.buckets(["word7", "word1500"], manifest)).count()
    assert every == 6000 and read < every / 4 and df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [Or" in plan or "term IN" in plan


def test_changes_give_what_a_rebuild_gives(spark, tmp_path, texts):
    path = f"file://{tmp_path}/i"
    index = KeywordIndex.build(spark, path, spark.createDataFrame(texts, CHANGES))
    now = {(r[0], r[1]): r for r in texts}
    rng = random.Random(9)
    for step in range(3):
        changes = [doc(i, rng.choice(["new words entirely", "", "the the launch", "launch plan plan"]), version=rng.choice([1, 2, 3 + step]), visible=rng.random() < 0.7, recording=i // 10) for i in rng.sample(range(320), 60)]
        changes += [doc(i, "twice in a batch", version=4 + step, recording=0) for i in (1, 2)] + [doc(1, "and overtaken", version=9 + step, recording=0)]
        for c in changes:
            old = now.get((c[0], c[1]))
            if old is None or c[2] > old[2]:
                now[c[0], c[1]] = c
        # Of equal versions in one batch any may stay: there are none here.
        versions = [(c[0], c[1], c[2]) for c in changes]
        assert len(set(versions)) == len(versions)
        index.apply(spark.createDataFrame(changes, CHANGES))
    fresh = KeywordIndex.build(spark, f"file://{tmp_path}/again", spark.createDataFrame(list(now.values()), CHANGES))
    want = everything(fresh)
    assert everything(index) == want
    before = index.log.version()
    assert index.compact(2) == before + 1 and everything(index) == want
    assert max(len(f) for f in index.log.manifest()["tables"]["postings"]["parts"].values()) == 1
    # A version that is named stays as it was.
    assert rows(index.postings(["launch"], 1)) == rows(KeywordIndex.build(spark, f"file://{tmp_path}/first", spark.createDataFrame(texts, CHANGES)).postings(["launch"]))


def test_a_stream_is_taken_in_once(spark, tmp_path):
    first = [doc(i, "old words here") for i in range(20)]
    index = KeywordIndex.build(spark, f"file://{tmp_path}/i", spark.createDataFrame(first, CHANGES))
    inbox, ledger = f"file://{tmp_path}/inbox", f"file://{tmp_path}/ledger"
    for part in ([doc(1, "", 2, False), doc(2, "corrected", 3)], [doc(2, "late", 2), doc(30, "added words", 1)]):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(inbox)
        index.follow(spark.readStream.schema(CHANGES).parquet(inbox), ledger).awaitTermination()
    want = [r for r in first if r[1] not in (1, 2)] + [doc(2, "corrected", 3), doc(30, "added words", 1)]
    fresh = KeywordIndex.build(spark, f"file://{tmp_path}/again", spark.createDataFrame(want, CHANGES))
    assert everything(index) == everything(fresh)
    version = index.log.version()
    assert index.apply(spark.createDataFrame([doc(3, "replayed", 9)], CHANGES), "changes", 1) == version and everything(index) == everything(fresh)


@pytest.mark.parametrize("name, query", [*[(name, "la la de") for name in search.STORED], ("LEX-07", "the"), ("RNK-01", "zzz nothing")])
def test_the_index_finds_what_a_scan_finds(spark, sf_dir, name, query):
    stored = procedures.by_words(name)(spark, sf_dir, query)
    scanned = plans.run(spark, sf_dir, name, query=query)
    shown = lambda df: sorted(tuple(None if x is None else round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert shown(stored) == shown(scanned)


SCRIPTS = ["Łódź café naïve", "Dvořák Škoda", "Nguyễn Trường", "Ἀθῆναι Ελλάδα", "Ёжик йод", "שָׁלוֹם", "İstanbul"]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_folding_in_every_script_and_form(spark, form):
    import unicodedata

    given = [unicodedata.normalize(form, s) for s in SCRIPTS]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").selectExpr("i", f"{SPARK.fold('s')} AS f")
    got = [r.f for r in df.orderBy("i").collect()]
    assert got == [folded(s) for s in SCRIPTS]
    assert got[:3] == ["łodz cafe naive", "dvorak skoda", "nguyen truong"] and got[4] == "ежик иод" and got[3] == "αθηναι ελλαδα" and got[5] == "שלום"


def test_two_libraries_in_one_session(spark):
    def make(word):
        lines = [(1, 1, 0, 0.0, 1.0, "A", "a", f"{word} here", 2.0, False, None, 0.0, None)]
        from test_api import SCHEMAS

        given = {"utterances": lines, "recordings": [(1, word, "f", None, "e", None, None, 1, "recording", None, True)], "tags": [(1, word, False)], "recording_tags": [(1, 1)], "speakers": [], "comments": [], "vectors": [], "meetings": [], "recording_meetings": []}
        return api.Library(spark, {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in given.items()})

    a, b = make("alpha"), make("beta")
    assert a.search("alpha", "keyword").hits.count() and not a.search("beta", "keyword").hits.count()
    assert b.search("beta", "keyword").hits.count() and [r.title for r in a.recordings().collect()] == ["alpha"] and [r.title for r in b.recordings().collect()] == ["beta"]


def test_a_library_searches_its_indexes(spark, tmp_path):
    from test_api import SCHEMAS

    lines = [(i, i // 4, i % 4, float(i), i + 1.0, "A", f"spk{i % 3}", f"customer launch {i}" if i % 2 else f"weekly review {i}", 3.0, i % 10 == 9, None, 0.0, None) for i in range(60)]
    given = {"utterances": lines, "recordings": [(i, f"Launch {i}", "f", None, f"e{i}", None, None, i, "recording", None, True) for i in range(15)], "tags": [(1, "Private", True)], "recording_tags": [], "speakers": [], "comments": [], "meetings": [], "recording_meetings": [],
             "vectors": [(i, i, i // 4, f"spk{i % 3}", 0, [math.cos(i / 9), math.sin(i / 9)]) for i in range(60)]}
    lib = api.Library(spark, {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in given.items()})
    look = lambda mode, **k: [(h.identity, round(h.score, 9)) for h in lib.search("customer launch", mode, limit=10, vector=[1.0, 0.2], **k).hits.orderBy("place").collect()]
    scope = api.Scope(speakers=("spk1",))
    want = [look(m) for m in ("keyword", "semantic", "hybrid")] + [look("keyword", scope=scope), look("semantic", scope=scope)]
    lib.index(f"file://{tmp_path}/idx")
    assert [look(m) for m in ("keyword", "ann", "hybrid")] + [look("keyword", scope=scope), look("ann", scope=scope)] == want
    assert lib.search("customer", "ann", vector=[1.0, 0.2]).complete


# --- vectors


def brute(x, ids, q, k):
    c = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return [ids[i] for i in np.lexsort((ids, -np.round(c, 9)))[:k]]


def test_recall_of_the_stored_vectors(spark, tmp_path):
    """On the given vectors, and on vectors that cluster, where few cells are opened."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F_id(), "embedding")
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.15
    clustered = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    for name, df, share in (("given", e, 1.0), ("clustered", clustered, 0.5)):
        index = VectorIndex.build(spark, f"file://{tmp_path}/{name}", df, cells=48)
        facts = index.log.manifest()["facts"]
        assert facts["probes"] <= share * facts["cells"]
        all_ = {r.id: np.array(r.embedding, dtype=float) for r in df.collect()}
        ids, y = np.array(sorted(all_)), np.array([all_[i] for i in sorted(all_)])
        asked = [i for i in ids if i % 20 == 0][:100]
        got = defaultdict(set)
        for r in index.search_all(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 20).collect():
            got[r.query_id].add(r.id)
        hit = sum(len(got[i] & set(brute(y, ids, all_[i], 20))) for i in asked)
        assert hit >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("side", [7, 50, 100_000])
def test_search_of_many_queries_in_groups_of_cells(spark, tmp_path, side):
    """Groups of many cells, and cells that lie in many groups, give what brute force gives; ties go to the smaller id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.3
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    index = VectorIndex.build(spark, f"file://{tmp_path}/{side}", df, cells=9)
    got = defaultdict(list)
    for r in index.search_all(df.where("id % 10 = 3").withColumnRenamed("id", "query_id"), 8, probes=9, side=side).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    assert got == {i: brute(x, np.arange(400), x[i], 8) for i in range(3, 400, 10)}
    one = index.search_all(df.where("id % 10 = 3").withColumnRenamed("id", "query_id"), 8, probes=1, side=side)
    assert one.count() > 0 and index.search_all(df.limit(0).withColumnRenamed("id", "query_id"), 8, side=side).count() == 0
    # A query meets cells in a task, not in a row for each vector.
    assert "FlatMapCoGroupsInArrow" in one._jdf.queryExecution().executedPlan().toString()


def F_id():
    from pyspark.sql import functions as F

    return F.col("vec_id").alias("id")


def test_complete_means_that_all_was_examined(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(20, 8)) * 0.05 + c for c in rng.normal(size=(40, 8))])
    df = spark.createDataFrame([(i, [float(v) for v in r], f"n{i}") for i, r in enumerate(x)] + [(900, [0.0] * 8, "zero"), (901, None, "null"), (902, [1.0], "short"), (903, [float("nan")] * 8, "nan")], "id long, embedding array<double>, name string")
    index = VectorIndex.build(spark, f"file://{tmp_path}/v", df, cells=40)
    ids, q = np.arange(800), [float(v) for v in x[5]]
    near = index.search(q, 5)
    assert [r.id for r in near.hits.orderBy("place").collect()] == brute(x, ids, x[5], 5) and near.hits.first().name.startswith("n")
    assert not near.complete and near.examined < 800 and near.opened < index.log.manifest()["facts"]["cells"]
    # Eligible ones that are far away: cells are opened until they are found.
    scope = spark.createDataFrame([(int(i),) for i in (790, 791, 600, 3)], "id long")
    few = index.search(q, 10, scope)
    assert few.complete and sorted(r.id for r in few.hits.collect()) == [3, 600, 790, 791] and few.examined == 4
    stopped = index.search(q, 10, scope, widest=2)
    assert not stopped.complete and stopped.opened == 2
    assert index.search(q, 10, scope.limit(0)).complete
    assert index.search(q, 800, most=1e-3).hits.count() == sum(1 - c <= 1e-3 for c in (x @ x[5]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[5])))
    assert index.search([0.0] * 8, 5).hits.count() == 0 and index.search([1.0], 5).hits.count() == 0


def test_appended_and_deleted_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    frame = lambda ids, y: spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, y, strict=True)], "id long, embedding array<double>")
    index = VectorIndex.build(spark, f"file://{tmp_path}/v", frame(range(300), x), cells=9)
    index.append(frame(range(290, 340), more := rng.normal(size=(50, 6))))
    index.delete(spark.createDataFrame([(i,) for i in (0, 1, 335, 999)], "id long"))
    index.append(frame([1], [x[7]]))
    all_ = dict(enumerate(x)) | dict(zip(range(290, 340), more, strict=True)) | {1: x[7]}
    del all_[0], all_[335]
    assert index.log.manifest()["facts"]["n"] == len(all_)
    ids, y = np.array(sorted(all_)), np.array([all_[i] for i in sorted(all_)])
    for q in (x[0], more[45], x[7]):
        found = index.search([float(v) for v in q], 400)
        assert found.complete and [r.id for r in found.hits.orderBy("place").collect()] == brute(y, ids, q, 400)


def test_an_index_of_nothing(spark, tmp_path):
    empty = VectorIndex.build(spark, f"file://{tmp_path}/v", spark.createDataFrame([], "id long, embedding array<double>"))
    assert empty.search([1.0, 2.0], 3).hits.count() == 0
    words = KeywordIndex.build(spark, f"file://{tmp_path}/w", spark.createDataFrame([], CHANGES))
    assert words.postings(["a"]).count() == 0 and words.corpus().count() == 0
    words.apply(spark.createDataFrame([doc(1, "a b a")], CHANGES))
    assert rows(words.postings(["a"])) == [("a", "transcript", 1, 3, (0, 2))]


# --- versions


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    frame = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    got = lambda version=None: sorted(tuple(r) for r in table.read(version).select("id", "v").collect())
    table.upsert(frame(*[(i, "a") for i in range(20)]))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            table.upsert(frame((1, "b")))
    assert table.version() == 1 and got() == [(i, "a") for i in range(20)]
    assert table.upsert(frame((1, "b"), (50, "new"))) == 2
    assert dict(got())[1] == "b" and len(got()) == 21 and len(got(1)) == 20  # a reader of version 1 still reads it


def test_of_two_writers_from_one_version_the_second_fails(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    table = Keyed(spark, f"file://{tmp_path}/t", ["id"])
    base = table.upsert(frame((1, "a"), (2, "a")))
    table.upsert(frame((1, "first")), base=base)
    with pytest.raises(Conflict):
        table.upsert(frame((1, "second")), base=base)
    assert dict((r.id, r.v) for r in table.read().collect()) == {1: "first", 2: "a"}
    log = Versions(spark, f"file://{tmp_path}/t")
    stale = log.manifest(1)
    monkey = log.version
    log.version = lambda: 1  # a race: both saw version 1; the rename tells them apart
    try:
        with pytest.raises(Exception) as e:
            log.commit(stale, stale["tables"], stale["facts"])
        assert e.value is not None
    finally:
        log.version = monkey
    assert log.version() == 2 and log.manifest()["tables"] != stale["tables"]


def test_upserts_deletes_and_replaced_groups(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), "id long, at long, v string")
    table = Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=3)
    table.upsert(frame(*[(i, 5, "old") for i in range(9)]), "at")
    table.upsert(frame((1, 4, "late"), (2, 6, "new"), (2, 7, "newer"), (20, 1, "added")), "at")
    now = {r.id: r.v for r in table.read().collect()}
    assert now[1] == "old" and now[2] == "newer" and now[20] == "added" and len(now) == 10
    table.delete(spark.createDataFrame([(i,) for i in range(9)], "id long"))
    assert [r.id for r in table.read().collect()] == [20]
    lines = Keyed(spark, f"file://{tmp_path}/l", ["id"], buckets=3)
    lines.replace(frame((1, 0, "a"), (1, 1, "b"), (2, 0, "c")), ["id"])
    lines.replace(frame((1, 0, "z")), ["id"])
    assert sorted(tuple(r) for r in lines.read().select("id", "at", "v").collect()) == [(1, 0, "z"), (2, 0, "c")]


def test_a_sample_is_what_the_driver_gets(spark):
    """The rows with the least hashes, whatever the number of tasks; a bound on the hash comes before the sort."""
    from pyspark.sql import functions as F

    from colloquy import storage

    rows = spark.range(40_000, numPartitions=16).withColumn("twice", F.col("id") * 2)
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(700).collect()]
    assert [r["id"] for r in storage.sample(rows, "id", 700, 40_000)] == want
    counted = spark.sparkContext.accumulator(0)
    where = rows.where(F.xxhash64("id") <= int(-(2**63) + (1.2 * 700 + 1000) / 40_000 * 2**64))
    where.foreach(lambda r: counted.add(1))
    assert 700 <= counted.value < 4 * 700
    same = spark.range(3000).select(F.lit(7).alias("id"))  # one key
    assert len(storage.sample(same, "id", 10, 3000)) == 10
    assert len(storage.sample(rows.limit(5), "id", 10, 5)) == 5


def test_modes_search_words_in_the_stored_index(spark, sf_dir, monkeypatch):
    from colloquy.plans import procedures

    given = []

    class Seen(procedures.Library):
        def __init__(self, *a, words=None, **k):
            given.append(words)
            super().__init__(*a, words=words, **k)

    monkeypatch.setattr(procedures, "Library", Seen)
    got = {(r.ready, r.asked): (r.ran, r.hits) for r in procedures.routed(spark, sf_dir).collect()}
    assert len(given) == 2 and None not in given
    assert got[True, "keyword"] == got[False, "keyword"] == got[False, "hybrid"] and got[False, "keyword"][0] == "keyword"
