import hashlib
import math
from collections import Counter

import pytest

from colloquy.llm import url_models
from colloquy.llm.url_models import Rule, judge


def verdicts(df, key="page_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def urls():
    out = []
    for i in range(60):
        out += [f"https://a{i % 7}.example.org/fr/{i}?x=1", f"http://b{i % 5}.shop.com/de/{i}#top", f"https://c{i % 3}.example.org/es/{i}", f"https://www.some.net/{('fr', 'de', 'es', 'en')[i % 4]}/{i}"]
    return [*out, None, "", "no scheme", "https://", "ftp://ORG/x", "http://EXAMPLE.Org/en/1é", "https://org", "https://a.com/fr/" + "long/" * 3000, *["https://twice.net/a"] * 9]


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = [r for r in url_models.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def brute(urls):
    """(verdict, score) by (host, path): the models written out for each position."""
    seen = {split(u): rule_of(*split(u)) for u in urls}
    width = url_models.WIDTH
    wins = {hp: [("\x02" * (width - 1) + "".join(hp) + "\x03")[i : i + width] for i in range(len("".join(hp)) + 1)] for hp in seen}
    fold = {hp: int(hashlib.md5("\0".join(hp).encode()).hexdigest()[0] >= "8") for hp in seen}

    def model(verdict, leave):
        grams = Counter(w[width - k :] for hp, r in seen.items() if r and r.verdict == verdict and fold[hp] != leave for w in wins[hp] for k in range(1, width + 1))
        follow, kinds = Counter(), Counter()
        for g, n in grams.items():
            follow[len(g), g[:-1]] += n
            kinds[len(g), g[:-1]] += 1

        def p(gram):
            rest = p(gram[1:]) if len(gram) > 1 else url_models.UNSEEN
            n, t = follow[len(gram), gram[:-1]], kinds[len(gram), gram[:-1]]
            return rest if n == 0 else (grams[gram] + t * rest) / (n + t)

        return p

    def score(hp, leave):
        a, r = model_of["allow", leave], model_of["block", leave]
        return sum(math.floor(math.log(a(w) / r(w)) * 1e6 + 0.5) for w in wins[hp]) / len(wins[hp]) / 1e6

    model_of = {(v, f): model(v, f) for v in ("allow", "block") for f in (0, 1, None)}
    held = [(score(hp, fold[hp]), r.verdict) for hp, r in seen.items() if r]
    good, bad = sum(v == "allow" for _, v in held), sum(v == "block" for _, v in held)
    right = lambda t: sum(math.floor(s * 100) >= t and v == "allow" for s, v in held) * bad + sum(math.floor(s * 100) < t and v == "block" for s, v in held) * good
    least = min({math.floor(s * 100) for s, _ in held}, key=lambda t: (-right(t), abs(t), t)) / 100
    return {hp: (r.verdict, None) if r else ("allow" if score(hp, None) >= least else "block", score(hp, None)) for hp, r in seen.items()}


def test_against_the_models_written_out(spark, urls):
    got = verdicts(judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")))
    want = brute(urls)
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = split(url)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (r.text if (r := rule_of(host, path)) else None)
        assert got[i].verdict == want[host, path][0], url
        assert got[i].score == (None if want[host, path][1] is None else pytest.approx(want[host, path][1], abs=1e-9))
    # What is like accepted URLs stands above what is like rejected ones.
    net = {p: [got[i].score for i, u in enumerate(urls) if u and f"some.net/{p}/" in u] for p in ("fr", "de", "es")}
    assert min(net["fr"]) > max(net["de"] + net["es"])


def test_the_longest_rule_wins(spark):
    rows = ["https://x.org/", "https://example.org/es/a", "https://EXAMPLE.org/en/1", "https://m.example.org/en/12?q", "https://example.org/en/2", "https://notexample.org/es/", "https://a.com/fr/", "https://com/de/x", "https://example.org/ES/", "https://org", "https://xorg/"]
    got = [verdicts(judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")))[i].rule for i in range(len(rows))]
    assert got == ["org/", "example.org/es/", "example.org/en/1", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", "org/", None, None]
    own = judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), (Rule("block", "b", "/"), Rule("allow", "b", "/c")))
    assert own.first().verdict == "allow"


def test_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "https://a.net/x"), (2, None), (None, "https://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in judge(df).collect()] == ["allow"] * 3
    assert judge(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("https://a.org/x", "h", "v", 1)], "url string, Host string, verdict string, key int")
    got = judge(df)
    assert got.columns == ["url", "Host", "verdict", "key", "_host", "path", "rule", "_verdict", "score"] and got.first()["_verdict"] == "allow" and got.first()["verdict"] == "v"


def test_hot_urls_and_windows(spark):
    rows = [(i, "https://hot.net/same" if i % 2 else f"https://h{i}.com/{'fr' if i % 4 else 'de'}/{i}") for i in range(4000)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert got.count() == 4000 and got.where("host = 'hot.net'").select("verdict", "score").distinct().count() == 1
