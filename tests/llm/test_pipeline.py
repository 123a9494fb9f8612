"""The pipeline against its operators, one stage after the other, and against brute force where that is short."""

import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from test_mixing import WORDS, shares
from test_quality_model import brute as scores

import corpus_pipeline
from colloquy.llm import queries
from colloquy.llm import mixing, near_copies, quality_model, quality_rules


def test_stages_on_what_the_one_before_kept(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            want = {r.doc_id for r in quality_rules.assess(before, ["doc_id"]).where("kept").collect()}
        elif name == "quality_classifier":
            want = {r.doc_id for r in quality_model.classify(before, ["doc_id"]).where("kept").collect()}
        elif name == "near_dedup":
            want = {r.class_id for r in near_copies.classes(before).collect()}
        elif name == "mixing":
            want = {r.doc_id for r in mixing.mix(before).where("times > 0").collect()}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in out.collect())
            want = set(texts)
        assert {r.doc_id for r in out.select("doc_id").collect()} == want
        assert name == "sentencepiece" or out.columns == names
        seen.append(out.count())
        before = out
    assert seen[0] < docs.count() and seen[2] <= seen[1] <= seen[0] and seen[4] == seen[3]


def made(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, junk, short texts and nulls, as Parquet."""
    r = random.Random(12)
    words = [("the " if i % 9 == 0 else "") + "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) + ("." if i % 12 == 0 else "") for i in range(900)]
    rows = [(i, made(r, words, r.randint(80, 200)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(8)]
    for i in range(8):
        w = rows[10 + i][1].split()
        w[r.randrange(20, 60)] = "edit"
        rows.append((120 + i, " ".join(w), "en", None))
    rows += [(140 + i, "### $$$ BUY!! " * 60, "en", "s2") for i in range(3)] + [(150 + i, made(r, words, 20), "en", "s3") for i in range(3)]
    rows += [(160, None, None, "s0"), (161, "", "fr", None), (None, made(r, words, 90), None, "s2"), (5, rows[5][1], "en", "s1")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def test_the_whole_pipeline_is_brute_force_stage_by_stage(spark, corpus):
    folder, _ = corpus
    docs = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    hashes = lambda rows: [x.h for x in sorted(spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(rows)], "i long, doc_id long, text string").selectExpr("i", "xxhash64(doc_id, text) AS h").collect(), key=lambda x: x.i)]
    # Quality rules, in SQL.
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cursor = c.execute(queries.ORACLE_SQL["op10_quality_rules"])
    names = [x[0] for x in cursor.description]
    kept = Counter(str(x[names.index("doc_id")]) for x in cursor.fetchall() if x[names.index("kept")])
    docs = [x for x in docs if str(x[0]) in kept]
    assert 60 < len(docs) < 90
    # Quality classifier.
    _, score = scores([x[:2] for x in docs], hashes(docs), quality_model.SAMPLE)
    docs = [x for x, s in zip(docs, score, strict=True) if s >= 0.5]
    # Near copies: components of all pairs, the least id of each stays.
    seq = [near_copies.sequence(near_copies.shingles(x[1])) for x in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if near_copies.similarity(seq[i], seq[j]) >= 0.8 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, x in zip(group, docs, strict=True):
        first[g] = min(first.get(g, x), x, key=lambda x: (x[0] is None, x[0] or 0))
    docs = list(first.values())
    # Mixing: each source's documents by hash, up to the sum that is nearest to what whole passes leave.
    size = [len(WORDS.findall(x[1])) for x in docs]
    sizes = defaultdict(int)
    for x, n in zip(docs, size, strict=True):
        sizes[x[3]] += n
    times = [0] * len(docs)
    h = [x % 2**64 for x in hashes(docs)]
    for s, target in shares(dict(sizes)).items():
        mine = sorted((i for i in range(len(docs)) if docs[i][3] == s), key=lambda i: h[i])
        passes = min(int(target / sizes[s]), 3)
        left = target - passes * sizes[s]
        for i in mine:
            more = left > 0 and size[i] - left <= left
            times[i] = passes + more
            left = left - size[i] if more and left > 0 else 0
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(x[0]), x[2], x[3], library.encode(x[1])) for x, n in zip(docs, times, strict=True) for _ in range(n))
    got = sorted((str(x.doc_id), x.lang, x.source, x.ids) for x in corpus_pipeline.run(spark, folder).collect())
    assert [x[0] for x in got] == [x[0] for x in want] and got == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_other_columns_and_empty_tables(spark, corpus, name):
    """Every row with a null, repeated rows and columns that operators name too; nothing fails, columns stay."""
    _, rows = corpus
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + rows[:3]] + [(None,) * 6] * 2, "doc_id long, text string, lang string, source string, score int, t int")
    out = stage(spark, df, "")
    found = out.collect()
    assert name == "sentencepiece" or out.columns == df.columns
    assert name == "mixing" or len(found) <= len(rows) + 5
    # The stages that filter judge the same text alike.
    if name in ("quality_rules", "quality_classifier"):
        by = Counter(x.text for x in found)
        whole = Counter(x[1] for x in rows + rows[:3])
        assert all(by[t] in (0, whole[t]) for t in whole if t is not None) and by[rows[0][1]] == whole[rows[0][1]]
    if name == "near_dedup":
        assert len({x.text or "" for x in found}) == len(found)
    assert stage(spark, df.limit(0), "").count() == 0
