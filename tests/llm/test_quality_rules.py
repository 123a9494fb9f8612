import math
import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def histogram(text, lang):
    w = WORD.findall(text or "")
    common = rules.COMMON_WORDS.get(lang)
    text = text or ""
    chars = [sum("a" <= c <= "z" for c in text), sum(c in " \t\n\x0b\x0c\r" for c in text), sum("A" <= c <= "Z" for c in text), sum(c in "0123456789" for c in text), sum(c in ".,;:!?'\"()-" for c in text), sum(c in "#*$%&|<>" for c in text)]
    words = [w.count(x) for x in common] + [sum(x not in common for x in w)] if common else None
    return chars + [len(text) - sum(chars)], words


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def test_counts_distances_and_verdicts(spark, sf_dir):
    extra = [(9000, None, None), (9001, "", "en"), (9002, "a b c a b c " * 40, "en"), (9003, "x\n\nx\n \ny\x0by\nx", "xx"), (9004, "the of and " * 20_000, "en"), (9005, "é😀 " * 300, "fr"), (None, "# $ <b> & " * 60, "de")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    rows = docs.collect()
    sums = {}
    for r in rows:
        k = r.lang if r.lang in rules.COMMON_WORDS else rules.OTHER
        c, w = histogram(r.text, k)
        old = sums.get(k, ([0] * len(c), [0] * len(w or [])))
        sums[k] = [x + y for x, y in zip(old[0], c, strict=True)], [x + y for x, y in zip(old[1], w or [], strict=True)]
    got = {r.doc_id: r for r in rules.assess(docs.withColumn("kept", F.lit(7)), ["doc_id", "kept"]).collect()}
    assert len(got) == len(rows)
    limits = rules.Limits()
    for r in rows:
        g = got[r.doc_id]
        n, *rest = counted(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, *rest)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        assert g.base_failed == failed and g.kept == 7
        k = r.lang if r.lang in rules.COMMON_WORDS else rules.OTHER
        c, w = histogram(r.text, k)
        a = js(c, sums[k][0]) if sum(c) >= limits.min_chars else None
        b = js(w, sums[k][1]) if w and n >= limits.min_words else None
        assert (g.char_distance is None) == (a is None) and (a is None or abs(a - g.char_distance) < 1e-9)
        assert (g.word_distance is None) == (b is None) and (b is None or abs(b - g.word_distance) < 1e-9)
        assert g["_kept"] == (not failed and (a or 0) <= limits.char_distance and (b or 0) <= limits.word_distance)


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = rules.assess(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_empty(spark):
    assert rules.assess(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
