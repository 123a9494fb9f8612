import hashlib
import html
import random
import time

import pytest

from colloquy.llm import html_text as h

CASES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>one<p>two<br>three": "one two three",
    "<p>a<b>b</b>c</p>  <p> d\n e </p>": "abc d e",
    "<article><h1>T</h1><p>x<p>y</article><footer>f</footer>": "T x y",
    "<body><nav>n</nav><div class='ad'>buy</div><main><p>x</p><aside>s</aside><form>f</form></main><div>outside</div>": "x",
    "<script>var a='<p>no</p>'</script><style>p{}</style><title>t</title><p>yes<!-- <p>no -->": "yes",
    "<article>a<div id=comments><article>c</article></div>b</article>": "a b",
    "<article><header><h1>T</h1></header>x</article><header>site</header>": "T x",
    "<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>": "yes",
    "<p>&lt;b&gt; &#65;&eacute;&nbsp;z": "<b> Aé z",
    "<ul><li>a<li>b</ul><div class='cookie-notice'>c": "a b",
    "<p title='a>b'>x</p><p>y < z</p>": "x y < z",
    "<div><p>unclosed <i>italic<p>next</div>after": "unclosed italic next after",
    "<textarea>no": "",
}


@pytest.mark.parametrize("source", CASES)
def test_blocks(source):
    assert h.article(source) == CASES[source]


def test_names_alone_delete_nothing():
    """A word within a class, a class on a paragraph, or hinted lines in the middle that are most of the text: all stay."""
    for source in ("<div class='social-history'>a</div><p>b", "<p>a<div id='search-results-study'>b</div><p>c", "<p class=reply>a<p>b", "<p>a<div class=comments>the longest part of all that is here</div><p>b"):
        assert h.article(source) == " ".join(x for x in h.re.sub("<[^>]*>", " ", source).split())
    assert h.article("<div class=ad>only this</div>") == "only this"
    assert h.article("<p>the article<p>goes on<div class='ad-slot top'>buy</div><p>and on") == "the article goes on and on"


def test_long_and_badly_nested_pages_take_linear_time():
    source = "<div><p><b>" * 40_000 + "x" + "</i></span></section></b>" * 40_000
    assert len(source) > 1_000_000
    began = time.process_time()
    assert [x for _, x in h.blocks(source)] == ["x"]
    assert time.process_time() - began < 2


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_common_subsequences_are_longest(cells, monkeypatch):
    monkeypatch.setattr(h, "CELLS", cells)
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = h.shared(a, b)
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in rest for i in got)


def prose(r, n):
    return ". ".join(" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(8)) for _ in range(n))


def test_differencing_deletes_what_neighbours_share(spark):
    r = random.Random(3)
    lines = ["Home page of host", "About us here", "Contact now", "All rights reserved 2020"]
    rows, truth = [], {}
    for i in range(60):
        body = [prose(r, 3) for _ in range(4)]
        truth[i] = " ".join(body)
        html = "<html><body>" + "".join(f"<div>{x}</div>" for x in lines[:3]) + "".join(f"<p>{x}" for x in body) + f"<div>{lines[3]}</div></body></html>"
        rows.append((i, f"http://h{i % 2}.example.org/a/{i // 10}/{i}", html, "x"))
    # Two copies next to each other keep their text; what can't be paired stays whole.
    rows += [(200, "http://c.example.org/x/1", "<p>same text in both", "x"), (201, "http://c.example.org/x/2", "<p>same text in both", "x")]
    # Short articles under a menu that is longer than they are.
    menu = "".join(f"<div>menu line {j} of this site</div>" for j in range(12))
    for i in range(210, 214):
        truth[i] = f"short {prose(r, 1)}"
        rows.append((i, f"http://m.example.org/{i}", menu + f"<p>{truth[i]}", "x"))
    # Near copies: a word differs, all other clauses are the same.
    near = [prose(r, 1) for _ in range(12)]
    for i in range(220, 222):
        own = [*near[:5], ". ".join([near[5], near[6], f"word{i}", near[7]]), *near[8:]]
        truth[i] = " ".join(own)
        rows.append((i, f"http://n.example.org/{i}", "".join(f"<p>{x}" for x in own), "x"))
    # Within an article element a line goes if the neighbours on both sides have it.
    for i in range(230, 236):
        text = prose(r, 4)
        truth[i] = f"{text} only in two" if i in (231, 232) else text
        rows.append((i, f"http://t.example.org/{i}", f"<article><p>Share this story<p>{text}{'<p>only in two' if i in (231, 232) else ''}</article>", "x"))
    truth[230], truth[235] = f"Share this story {truth[230]}", f"Share this story {truth[235]}"
    rows += [(500, None, None, None), (501, "http://[bad", "<p>x", None), (502, "", "", None), (503, "http://h/x", "plain &amp; more", None), (503, "http://h/x", "plain &amp; more", None), (None, "http://q/", "<p>q", None)]
    truth |= {200: "same text in both", 201: "same text in both", 500: "", 501: "x", 502: "", 503: "plain & more", None: "q"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS lines", "2 AS k")
    got = h.main_text(df).collect()
    assert sorted((str(x.page_id), x.text, x.n_chars) for x in got) == sorted((str(p), truth[p], len(truth[p])) for p, *_ in rows)
    assert h.main_text(df.limit(0)).count() == 0


def test_pairs_and_deletions_are_those_of_brute_force(spark):
    r = random.Random(7)
    template = [f"template {j}" for j in range(20)]
    pages = []
    for i in range(240):
        host, some = r.randrange(5), sorted(r.sample(range(20), r.randint(0, 6)))
        own = [f"own {i} {j} {prose(r, 1)}" for j in range(r.randint(1, 3))]
        lines = [template[j] for j in some if j < 10] + own + [template[j] for j in some if j >= 10]
        pages.append((i, f"http://h{host}/{r.choice('abc')}/{r.randrange(60)}", lines, i % 3 == 0))
    pages += [(300 + i, f"http://h0/b/{i}", pages[0][2], pages[0][3]) for i in range(20)]

    def start(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    hosts = {}
    for i, url, lines, main in pages:
        host, path = h.path_of(url)
        hosts.setdefault(host, {}).setdefault((main, tuple(lines)), []).append((path, i))
    want = {}
    for found in hosts.values():
        row = sorted((min(p for p, _ in at), key, [i for _, i in at]) for key, at in found.items())
        row.sort(key=lambda x: (x[0], h_page(x[1])))
        for j, (path, (main, lines), members) in enumerate(row):
            near = [row[k] for k in (j - 1, j + 1) if 0 <= k < len(row)]
            # Template lines stand in one order and once, so what two pages have in common is their longest common subsequence.
            both = [(start(path, p), {x for x in lines if x in other}) for p, (_, other), _ in near]
            holders = lambda x: sum(m and x in other for _, (m, other), _ in row)  # noqa: B023, E731
            articles = sum(m for _, (m, _), _ in row)
            gone = {x for x in set.intersection(*[g for _, g in both]) if holders(x) >= 3 and 2 * holders(x) > articles} if main and len(both) == 2 else set() if main else max(both, key=lambda x: x[0])[1] if both else set()
            for i in members:
                if gone:
                    want[i] = [k for k, x in enumerate(lines) if x in gone]
    built = lambda lines, main: ("<article>" if main else "") + "".join(f"<p>{x}" for x in lines)
    df = spark.createDataFrame([(i, url, built(lines, main)) for i, url, lines, main in pages], "_k long, url string, html string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.k: x.gone for x in h.deletions(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want and len(want) > 60


def h_page(key):
    main, lines = key
    return hashlib.md5(",".join([str(main).lower(), *(str(h.line_hash(x)) for x in lines)]).encode()).hexdigest()


def test_paragraphs_of_articles_are_judged_alike_on_a_host(spark):
    """A notice in all articles of a host goes; a paragraph that many articles quote stays, neighbours or not."""
    quote, notice = "a paragraph that is quoted", "subscribe to all of it"
    rows, want = [], {}
    for i in range(60):
        own = [f"article {i} says {j}" for j in range(3)] + ([quote] if i % 5 < 2 else [])
        rows.append((i, f"http://a.example.org/{i:03d}", "<article>" + "".join(f"<p>{x}" for x in [own[0], notice, *own[1:]]) + "</article>"))
        rows.append((100 + i, f"http://b.example.org/{i:03d}", "<article>" + "".join(f"<p>{x}" for x in own) + "</article>"))
        want[100 + i] = " ".join(own)
        want[i] = " ".join([own[0], *([notice] if i in (0, 59) else []), *own[1:]])  # the first and the last have one neighbour
    # Three pages, all with a paragraph: also template.
    rows += [(200 + i, f"http://c.example.org/{i}", f"<article><p>text {i}.<p>{quote}</article>") for i in range(3)]
    got = {x.page_id: x.text for x in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v for k, v in got.items() if k < 200} == want
    assert [got[200 + i] for i in range(3)] == [f"text 0. {quote}", "text 1.", f"text 2. {quote}"]


def test_pages_of_the_tables(spark):
    """On the tables every article is in its text whole, with paragraphs that other articles have as well, and nothing of the site is."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source, n = {r.page_id: r.html for r in pages.collect()}, 0
    for x in h.main_text(pages).collect():
        assert x.n_chars == len(x.text)
        whole = source[x.page_id] or ""
        if whole.count("<article>") == 1 and "<div" not in (inside := whole.split("<article>")[1].split("</article>")[0]) and not h.re.search("<(?!/?(?:p|b|h1|br|em|i)>)[a-zA-Z/!]", inside):
            # By markup that is this plain, a text is what is left without its tags.
            parts = [" ".join(html.unescape(h.re.sub("</?(?:b|em|i)>", "", t)).split()) for t in h.re.split("</?(?:p|h1)>|<br>", inside)]
            assert x.text == " ".join(t for t in parts if t)
            n += 1
    assert n > 50, n
