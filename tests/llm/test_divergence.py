import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, most=200):
    """Every group against every other, over the whole vocabulary."""
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(UPPER))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = {}
    for lang in {r[1] for r in rows}:
        vocabulary = [t for t, n in seen[lang].items() if n >= least]
        groups = sorted(s for x, s in counts if x == lang)
        p = lambda n, whole: 1 + 10**9 * (n + 1) // (whole + len(vocabulary))
        whole = {s: sum(counts[lang, s][t] for t in vocabulary) for s in groups}
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            mine = {t: p(counts[lang, s][t], whole[s]) for t in vocabulary}
            pairs = [(sum(f(mine[t], p(counts[lang, o][t], whole[o])) for t in vocabulary), o) for o in groups if o != s]
            terms = []
            for t in vocabulary:
                q = p(sum(counts[lang, o][t] for o in groups), sum(whole.values()))
                if counts[lang, s][t] and mine[t] > q:
                    terms.append((f(mine[t], q), t))
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n], 1):
                    out[lang, s, part, item] = (v, rank)
    return out


def rows_of(df):
    rows = df.collect()
    out = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def documents():
    words = "the The ÉTÉ été don't a1b2 naïve 日本 x_y zeta eta theta iota".split()
    rows = [(" ".join(words[(i * j + j * j) % len(words)] for j in range(1 + i % 9)), ("en", "fr", None)[i % 3], (None, "s1", "s2", "s3", "é")[i % 5]) for i in range(80)]
    return rows + [(None, "en", "quiet"), ("", "en", "s1"), ("solo", "xx", "a"), ("other", "xx", "b"), ("only", "yy", "z"), ("the " * 300, "en", "s2")] + [("same same words", "en", "s1")] * 4


def test_against_every_group_over_the_whole_vocabulary(spark, documents):
    df = spark.createDataFrame(documents, "text string, lang string, source string")
    want = brute(documents)
    assert rows_of(divergence.audit(df)) == want
    # Groups without a kept term are there: without a vocabulary pairs are 0, else they are those of zero counts.
    assert want["xx", "a", "pair", "b"] == (0, 1) and want["en", "quiet", "pair", "s1"][0] > 0
    assert rows_of(divergence.audit(df, most_terms=2)) == brute(documents, most=2)
    assert rows_of(divergence.audit(df, least_docs=1)) == brute(documents, least=1)


def test_terms_and_counts(spark):
    df = spark.createDataFrame([("AB ab Ab1cd É_é", "en", "s")] * 2 + [(None, None, None)], "text string, lang string, source string")
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(df).collect()}
    assert got == {("en", "s", t): (n, 2) for t, n in {"ab": 6, "cd": 2, "É": 2, "é": 2}.items()}


def test_large_counts_are_exact(spark):
    cases = [(n, whole) for n in (0, 1, 8_999_999_998, 8_999_999_999, 9_000_000_000, 10**15 + 7) for whole in (n + 1, n + 12_345, 3 * 10**15 + 1)]
    df = spark.createDataFrame(cases, "n long, whole long").selectExpr("n", "whole", f"{divergence.probability('n', 'whole')} AS p")
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.whole for r in df.collect())


def test_empty_and_clashing(spark, documents):
    schema = "text string, lang string, source string, item string, value int, rank int, n int, part string, term string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    wide = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z") for r in documents[:30]], schema)
    assert rows_of(divergence.audit(wide)) == brute(documents[:30])


def test_words_are_counted_by_slice():
    odd = ["@A[B`C{D", "a\x00b\x1cc\x7fd\x85e\xa0F", "  K K k İ İ", "  ", "", "😀x 日本Z", "Zz zZ zz", "é É é", "A" * 300] * 5
    rows = [(("en", "fr", "")[i % 3], ("", "s")[i % 2], t) for i, t in enumerate(odd)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    n, docs = Counter(), Counter()
    for lang, source, t in rows:
        found = TERM.findall(t.translate(UPPER))
        n.update((lang, source, x) for x in found)
        docs.update((lang, source, x) for x in set(found))
    for size in (1, 4, 7, len(rows)):
        got = [r for i in range(0, len(rows), size) for r in divergence.counted(batch.slice(i, size)).to_pylist()]
        for want, c in ((n, "n"), (docs, "docs")):
            sums = Counter()
            for r in got:
                sums[r["lang"], r["source"], r["term"]] += r[c]
            assert sums == want
    # One row for each term of a group in a slice, and none where there is no term.
    assert len(got) == len(n)
    assert divergence.counted(batch.slice(3, 2)).num_rows == 0


def test_slices_hold_every_text(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 10)
    monkeypatch.setattr(divergence, "SLICE_ROWS", 3)
    for sizes, want in (([], []), ([50], [1]), ([0] * 7, [3, 3, 1]), ([9, 9, 1], [2, 1]), ([50, 50, 0, 0, 0, 0], [1, 1, 3, 1])):
        got = list(divergence.slices(np.array(sizes, np.int32)))
        assert [n for _, n in got] == want and [i for i, _ in got] == [sum(want[:k]) for k in range(len(want))]


def test_terms_are_shuffled_once_as_sums_of_slices(spark, documents):
    df = spark.createDataFrame(documents, "text string, lang string, source string")
    plan = divergence.postings(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "regexp_extract_all" not in plan
    # Few rows are shuffled for many words: a row for each term of a group, however often it is there.
    many = spark.createDataFrame([("a b c " * 1000, "en", "s")] * 50, "text string, lang string, source string").coalesce(1)
    assert sorted((r.term, r.n, r.docs) for r in divergence.term_counts(many).collect()) == [(t, 50_000, 50) for t in "abc"]
