import math
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import language


def test_the_query_is_the_formula_row_by_row(spark, sf_dir):
    """Brute force: every sum is taken anew for each page, over all other pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = [(9001, None, None), (9002, "http://a.blog.co.uk/fr/1", "<p>the and of"), (9003, "http://b.blog.co.uk/", "<p>der die das und"), (9004, "http://10.0.0.1/es/", "<p>" + "el los por para " * 30_000), (9004, "http://10.0.0.1/es/", "<p>12"), (None, "http://b.blog.co.uk/x", '<html lang="de">')]
    wide = pages.unionByName(spark.createDataFrame(extra, pages.schema)).selectExpr("*", "1 AS text", "2 AS host", "3 AS p", "4 AS prior")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("text", "lang", "1 AS h")
    got = sorted(language.identify(wide, labelled, 40).collect(), key=lambda r: (str(r.page_id), r.confidence))
    model = language.fit_text(labelled, 40)
    n = len(model.languages)
    rows = language.evidence(wide, model).collect()
    text = np.array([r.text for r in rows])
    p = np.exp(text) / np.exp(text).sum(axis=1, keepdims=True)
    codes = {k: len({getattr(r, k) for r in rows} - {None}) for k in ("declared", "code")}
    want = []
    for i, r in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        prior = (p[others].sum(axis=0) + 1) / (len(others) + n)
        for level in ("suffix", "domain", "host"):
            s = sum((p[j] for j in others if getattr(rows[j], level) == getattr(r, level)), np.zeros(n))
            prior = (s + language.STRENGTH * prior) / (s.sum() + language.STRENGTH)
        log = text[i] + np.log(prior)
        for k in ("declared", "code"):
            if getattr(r, k) is not None:
                same = sum((p[j] for j in others if getattr(rows[j], k) == getattr(r, k)), np.zeros(n))
                some = sum((p[j] for j in others if getattr(rows[j], k) is not None), np.zeros(n))
                log = log + np.log((same + language.CODE_SMOOTHING) / (some + language.CODE_SMOOTHING * (codes[k] + 1)))
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        want.append((str(r.page_id), model.languages[int(np.argmax(post))], post.max()))
    want.sort(key=lambda x: (x[0], x[2]))
    assert [(str(g.page_id), g.lang) for g in got] == [w[:2] for w in want]
    assert [g.confidence for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def test_the_sample_is_the_least_hashes(spark):
    rows = [(f"text {i}", "en" if i % 3 else "de") for i in range(900)] + [("text 1", "en")] * 400 + [("only", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    hashed = {(r.lang, r.text): r.h % 2**64 for r in df.distinct().selectExpr("lang", "text", "xxhash64(text) AS h").collect()}
    t = df.selectExpr("lang", "xxhash64(text) AS h", "text")
    counts = Counter(lang for lang, _ in hashed)
    got = {(r.lang, r.text) for r in t.where(language._sampled(t.select("lang", "h").distinct(), counts, 100)).collect()}
    for lang in ("en", "de", "fr"):
        order = sorted((h, x) for (k, x), h in hashed.items() if k == lang)
        assert {x for k, x in got if k == lang} == {x for _, x in order[:100]}
    # The model is that of the sample, by counts of n-grams.
    model = language.fit_text(df, 100)
    sums = np.full((language.BUCKETS, 3), 0.5)
    for k, x in got:
        for w in language.LETTERS.findall(x):
            for g in language.grams(w):
                sums[g, model.languages.index(k)] += 1
    assert np.allclose(model.log_p, np.log(sums / sums.sum(axis=0))) and math.isfinite(model.log_p.sum())


def test_pages_and_evidence(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"), spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, None), (9002, "http://x.de/", ""), (9003, "http://[", '<html lang="fr">'), (9004, "http://y.org/es/1", "<p>12 34</p>"), (9004, "http://y.org/es/1", "<p>12 34</p>")]
    got = language.identify(pages.unionByName(spark.createDataFrame(extra, pages.schema)), docs, sample=60).collect()
    assert len(got) == pages.count() + 5
    by = {r.page_id: r for r in got}
    assert [by[i].lang for i in (9002, 9003, 9004)] == ["de", "fr", "es"] and by[9001].lang in {"en", "de", "fr", "es"}
    # The path names the language that a page was written in; it is held back here by judging the text alone.
    own = [r for r in got if r.page_id < 9000]
    assert sum(r.text_lang == r.code for r in own) >= 0.97 * len(own)
    assert sum(r.lang == r.code for r in own) >= 0.99 * len(own)
    assert all(0 < r.confidence <= 1 + 1e-9 for r in got)


def test_nothing_to_learn_from_and_nothing_to_judge(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<p>text")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "text string, lang string")
    assert [r.lang for r in language.identify(pages, none).collect()] == ["und"]
    some = spark.createDataFrame([("the and of", "en"), (None, "de"), ("x", None)], "text string, lang string")
    assert language.identify(pages.limit(0), some).count() == 0


def test_addresses():
    assert language.address("https://www.a.example.de/fr/x?y") == ("www.a.example.de", "example.de", "de", "fr")
    assert language.address("https://a.de/francais") == ("a.de", "a.de", "de", "de")
    assert language.address("http://www.bbc.co.uk/") == ("www.bbc.co.uk", "bbc.co.uk", "uk", "uk")
    assert language.address("http://10.0.0.1/en/") == ("10.0.0.1", "10.0.0.1", "", "en")
    assert language.address(None) == ("", "", "", None)
    assert language.declared("<!doctype html><html class=a lang=de-AT>") == "de" and language.declared("<p>") is None
    assert language.declared("<meta http-equiv=content-language content=fr>" + "x" * 5000 + "<html lang=en>") == "en"
