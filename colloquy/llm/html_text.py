"""Main text of web pages by page differencing: what a page shares with its nearest page by URL is template.

1. A page is cut into blocks, the lines of its text. Elements whose meaning is something else than the article (nav,
   footer, aside, form, script, a navigation role, what isn't shown) have no lines. If there is an article or main
   element, the article's lines are in it. A class or id such as "ad" or "comments" is a hint only: lines below it go if a
   second sign agrees, which is that they stand before or after all other lines, or are less than the others, or that
   the neighbours share them.
2. Within a host, the different pages (by their lines; copies are one page) are put in order by URL path, and each is
   paired with those next to it. The lines of a pair are aligned by longest common subsequence. A line that both have is
   template and is deleted: on a page without an article element if the neighbour with the longer common beginning of
   the path has it, in an article element if the neighbours on both sides have it and more than half of the host's pages with such an
   element hold it, three at least. Neighbours may have a paragraph in common by chance, as quoted and copied texts are;
   what stands in most articles of a host belongs to the host.
3. A pair of near copies says nothing about templates: if the clauses of the lines that a pair doesn't share are the same
   for a good part, or if one page holds all of the other, it is left aside, whatever it shares.

Pairs are the same whatever the partitions: pages are sorted by range, so that a large host lies in many partitions, and
the first and last row of each are joined to the partitions next to it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, hot_keys, salted

# Elements, by what they do to text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "canvas", "audio", "video", "object"}
JUNK = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "option", "label", "input", "fieldset", "datalist", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
#: Roles that say what JUNK elements say.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "toolbar"}
#: Class and id names that hint at something else than the article, and what may stand beside them in a name ("ad-slot").
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "sidebar", "aside",
    "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "replies",
    "respond", "disqus", "complementary", "contentinfo", "pagination", "pager", "toolbar", "copyright",
}
BESIDE = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "header", "inner", "item", "items", "left", "links", "list", "main", "page", "policy", "post", "posts", "primary", "reader", "right", "section", "site", "slot", "thread", "top", "unit", "user", "widget", "widgets", "wrap", "wrapper"}
#: Elements on which a class or id can be a hint. A paragraph, a heading or a list item is text, whatever it is called.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "span", "center", "details"}
MARKUP = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")
CLAUSE = re.compile(r"[^.!?,;:]+")
OPEN, TEXT, HINTED = 0, 1, 2  # HINTED is added to either
#: Two pages are near copies if they have this part of the clauses of the lines that they don't share in common.
NEAR = 1 / 3
#: Cells of one LCS table; above, the alignment is split in halves.
CELLS = 4_000_000
#: Articles of a host that hold a line before it can be the host's.
LEAST = 3
#: Pages in one range of the order of a host's paths.
RANGE = 20_000


def named(attributes: str) -> tuple[bool, bool]:
    """Whether markup says that an element isn't part of the article or isn't shown, and whether class or id hint at it."""
    junk = hint = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            junk = True
        elif name == "role":
            junk = junk or not ROLES.isdisjoint(value.lower().split())
        elif name in ("class", "id"):
            for token in value.split():
                parts = {w.lower() for w in WORDS.findall(token)}
                hint = hint or (not HINTS.isdisjoint(parts) and all(w in HINTS or w in BESIDE or w.isdigit() for w in parts))
    return junk, hint


class _Open:
    """The elements that are open: what they say of the text below them, and for each name the places where it is open."""

    def __init__(self):
        self.all: list[tuple[str, bool, bool, bool]] = []  # name, junk, main text, hint
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places of those that an inline end tag or that of a paragraph doesn't close
        self.junk = self.main = self.hint = 0

    def push(self, name: str, junk: bool, main: bool, hint: bool) -> None:
        self.places.setdefault(name, []).append(len(self.all))
        if name not in INLINE and name != "p":
            self.walls.append(len(self.all))
        self.all.append((name, junk, main, hint))
        self.junk, self.main, self.hint = self.junk + junk, self.main + main, self.hint + hint

    def pop(self) -> None:
        name, junk, main, hint = self.all.pop()
        self.places[name].pop()
        if self.walls and self.walls[-1] == len(self.all):
            self.walls.pop()
        self.junk, self.main, self.hint = self.junk - junk, self.main - main, self.hint - hint

    def closes(self, name: str) -> int | None:
        """The place of the element that an end tag closes, if it closes any."""
        places = self.places.get(name)
        if not places:
            return None
        at = places[-1]
        if (name in INLINE or name == "p") and self.walls and self.walls[-1] > at:
            return None
        return None if name in INLINE and at < len(self.all) - 4 else at


def blocks(source: str) -> list[tuple[int, str]]:
    """(OPEN or TEXT, with HINTED or without; line) of each block with text, in page order.

    What markup names as something else isn't there. TEXT: inside article or main. An article within such an element or
    below a hint, such as a comment, isn't text of its own. Unclosed elements end with the page or with the end of what
    holds them; a document without tags is one open block. Time is linear in the source.
    """
    out: list[tuple[int, str]] = []
    stack = _Open()
    parts: list[str] = []
    at = 0

    def close() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(((TEXT if stack.main else OPEN) + HINTED * bool(stack.hint), text))
            parts.clear()

    n, find = len(source), MARKUP.search
    while m := find(source, at):
        if m.start() > at and not stack.junk:
            parts.append(source[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name not in INLINE:
                close()
            until = stack.closes(name)
            if until is not None:
                while len(stack.all) > until:
                    if any(stack.all[-1][1:]):
                        close()
                    stack.pop()
            continue
        if name in RAW:
            if name not in INLINE:
                close()
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        junk, hint = named(m.group(3)) if m.group(3) and name not in ("html", "body", "article", "main") else (False, False)
        # A header inside the article holds its title; as a child of the page it is the page's own.
        junk = junk or (name in JUNK and not (name == "header" and stack.main))
        hint = hint and name in CONTAINERS
        main = name in MAIN and not stack.junk and not stack.hint
        if junk or main or hint:
            close()
        if name in ("p", "li", "td", "tr", "option") and stack.all and stack.all[-1] == (name, False, False, False):
            stack.pop()  # these end where the next one starts
        stack.push(name, junk, main, hint)
    if at < n and not stack.junk:
        parts.append(source[at:])
    close()
    return out


def candidates(found: list[tuple[int, str]]) -> tuple[bool, list[tuple[bool, str]]]:
    """Whether a page has an article element, and the (hinted, line) that can be its article: those in it, or else all."""
    main = any(k & TEXT for k, _ in found)
    return main, [(bool(k & HINTED), x) for k, x in found if not main or k & TEXT]


def chosen(lines: list[tuple[bool, str]], gone: list[int] = ()) -> list[str]:
    """The lines of the article: without those deleted (positions), and without hinted ones if a second sign agrees."""
    gone = set(gone)
    plain = [i for i, (hint, _) in enumerate(lines) if not hint and i not in gone]
    if not plain:
        return [x for i, (_, x) in enumerate(lines) if i not in gone]
    less = sum(len(x) for hint, x in lines if hint) < sum(len(lines[i][1]) for i in plain)
    return [x for i, (hint, x) in enumerate(lines) if i not in gone and not (hint and (less or i < plain[0] or i > plain[-1]))]


def article(source: str) -> str:
    """The text of one page by its markup alone."""
    return " ".join(chosen(candidates(blocks(source))[1]))


def line_hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return (crc32(raw) << 31 ^ crc32(raw, 0x9E3779B9)) & 0x7FFFFFFFFFFFFFFF


def path_of(url: str | None) -> tuple[str, str]:
    """Host and path; query and fragment don't count. A URL that can't be parsed is a path of no host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x = [(i, v) for i, v in enumerate(a) if head <= i < len(a) - tail and v in both]
    y = [v for v in b[head : len(b) - tail] if v in both]
    return [*range(head), *_middle(x, y), *range(len(a) - tail, len(a))]


def _middle(x: list[tuple[int, int]], y: list[int]) -> list[int]:
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > CELLS:
        # Where the best path crosses the middle of x, from the lengths of both halves against every part of y.
        half = len(x) // 2
        left, right = _lengths([v for _, v in x[:half]], y), _lengths([v for _, v in x[half:][::-1]], y[::-1])
        at = max(range(len(y) + 1), key=lambda k: left[k] + right[len(y) - k])
        return _middle(x[:half], y[:at]) + _middle(x[half:], y[at:])
    # Rows of the table as integers, a bit for each element of y: bit j is clear if the length grows at j.
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [full], full
    for _, value in x:
        u = v & where[value] if value in where else 0
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1  # no growth at j: the path comes from the left
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(x[i - 1][0])
            i, j = i - 1, j - 1
    return out[::-1]


def _lengths(x: list[int], y: list[int]) -> list[int]:
    """The length of the longest common subsequence of x and each beginning of y."""
    where: dict[int, int] = {}
    for j, value in enumerate(y):
        where[value] = where.get(value, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for value in x:
        u = v & where.get(value, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for j in range(len(y)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return bisect_left(range(n), True, key=lambda i: a[: i + 1] != b[: i + 1])


def clauses(text: str) -> list[int]:
    return [crc32(x.encode("utf-8", "surrogatepass")) for part in CLAUSE.findall(text) if (x := part.strip())]


def template(lines: list[int], marks: list[list[int]], other: list[int], other_marks: list[list[int]]) -> list[int] | None:
    """Positions of the lines that both pages have, or None if the two pages are near copies.

    ``marks``: the clauses of each line. What the pair doesn't share tells the one case from the other: other articles have
    other clauses there, edited copies have mostly the same, and a page that holds the other has nothing.
    """
    if set(lines).isdisjoint(other):
        return []
    got, back = set(shared(lines, other)), set(shared(other, lines))
    mine = {c for i, x in enumerate(marks) if i not in got for c in x}
    theirs = {c for i, x in enumerate(other_marks) if i not in back for c in x}
    if not mine or not theirs or len(mine & theirs) >= NEAR * min(len(mine), len(theirs)):
        return None
    return sorted(got)


def to_delete(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """Positions of a page's template lines; ``before`` and ``after``: the pages next to it on its host, if any."""
    found = [(common_start(x["path"], page["path"]), got) for x in (before, after) if x is not None and (got := template(page["lines"], page["marks"], x["lines"], x["marks"])) is not None]
    if page["main"]:
        return sorted(set(found[0][1]) & set(found[1][1])) if len(found) == 2 else []
    return max(found, key=lambda x: x[0])[1] if found else []


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row key, url, html -> row key, host, path, whether it has an article element, lines (hashes), clauses of each."""
    for whole in batches:
        for i in range(0, whole.num_rows, 250):
            batch = whole.slice(i, 250)
            urls = [path_of(u) for u in batch.column(1).to_pylist()]
            pages = [candidates(blocks(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array([m for m, _ in pages], pa.bool_()), pa.array([[line_hash(x) for _, x in t] for _, t in pages], pa.list_(pa.int64())), pa.array([[clauses(x) for _, x in t] for _, t in pages], pa.list_(pa.list_(pa.int64())))],
                ["k", "host", "path", "main", "lines", "marks"],
            )


def of_hosts(gone: DataFrame, pages: DataFrame) -> DataFrame:
    """host, page, gone: of what differencing found in articles the lines that more than half of the host's articles, and three at
    least, hold.

    A host has at most twice as many such lines as an article of its has on average, so they are one row for each host.
    """
    total = pages.groupBy("host").agg(F.count("*").alias("n"))
    held = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("m"))
    template = held.join(total, "host").where((F.col("m") >= LEAST) & (F.col("m") * 2 > F.col("n"))).groupBy("host").agg(F.collect_list("line").alias("template"))
    found = salted(gone, template, "host", hot_keys(total, "host", "n"), F.xxhash64("page"))
    places = F.arrays_zip(F.col("gone").alias("place"), F.col("at").alias("line"))
    # One look-up for each distinct line of the page, by the set of both.
    return found.withColumn("both", F.array_intersect("at", "template")).where(F.size("both") > 0).select("host", "page", F.transform(F.filter(places, lambda x: F.array_contains(F.col("both"), x["line"])), lambda x: x["place"]).alias("gone"))


def deletions(pages: DataFrame) -> DataFrame:
    """k, gone: for row keys with lines to delete, the positions of these among the page's candidate lines."""
    spark = pages.sparkSession
    outline = pages.select("_k", "url", "html").mapInArrow(_outline, "k bigint, host string, path string, main boolean, lines array<bigint>, marks array<array<bigint>>")
    outline = cut(outline.where(F.size("lines") > 0).withColumn("page", F.md5(F.concat_ws(",", F.col("main").cast("string"), F.col("lines").cast("array<string>")))), "outline")
    # Copies on a host are one page, at the least of their paths.
    each = outline.groupBy("host", "page").agg(F.min("path").alias("path"), F.first("main").alias("main"), F.first("lines").alias("lines"), F.first("marks").alias("marks"))
    row = ["host", "path", "page", "main", "lines", "marks"]
    ranges = max(spark.sparkContext.defaultParallelism, -(-outline.count() // RANGE))
    ordered = each.repartitionByRange(ranges, "host", "path", "page").withColumn("part", F.spark_partition_id()).select("part", *row)
    ordered = cut(ordered, "ordered")
    # The first and the last row of each partition go to the partition before and after as well. Only numbers of
    # partitions reach the driver.
    parts = sorted(r["part"] for r in ordered.select("part").distinct().collect())
    beside = spark.createDataFrame([(p, q, 1) for p, q in zip(parts, parts[1:], strict=False)] + [(q, p, -1) for p, q in zip(parts, parts[1:], strict=False)], "part int, to int, edge int")
    whole = F.struct(*row)
    ends = ordered.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    ends = ends.join(F.broadcast(beside), "part").select(F.col("to").alias("part"), "edge", F.when(F.col("edge") == 1, F.col("last")).otherwise(F.col("first")).alias("r")).select("part", "edge", "r.*")
    both = ordered.select("part", F.lit(0).alias("edge"), *row).unionByName(ends)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["host", "path", "page"], kind="stable").to_dict("records")
        for r in rows:
            r["lines"], r["marks"] = [int(x) for x in r["lines"]], [[int(c) for c in x] for x in r["marks"]]
        got = []
        for i, r in enumerate(rows):
            if r["edge"] == 0:
                near = [rows[j] if 0 <= j < len(rows) and rows[j]["host"] == r["host"] else None for j in (i - 1, i + 1)]
                if gone := to_delete(r, *near):
                    got.append((r["host"], r["page"], r["main"], gone, [r["lines"][k] for k in gone]))
        return pd.DataFrame(got, columns=["host", "page", "main", "gone", "at"])

    # A part is one range of the sort, of RANGE pages, and holds hashes, not text.
    gone = cut(both.groupBy("part").applyInPandas(run, "host string, page string, main boolean, gone array<int>, at array<bigint>"), "gone")
    gone = gone.where("NOT main").select("host", "page", "gone").unionByName(of_hosts(gone.where("main"), ordered.where("main")))
    gone = cut(gone.where(F.size("gone") > 0), "gone")
    if gone.isEmpty():
        return spark.createDataFrame([], "k bigint, gone array<int>")
    own = F.concat_ws(" ", "page", "host").alias("p")
    keyed, gone = outline.select("k", own), gone.select(own, "gone")
    heavy = hot_keys(keyed.groupBy("p").agg(F.count("*").alias("n")), "p", "n")
    return salted(keyed, gone, "p", heavy, F.xxhash64("k")).select("k", "gone").dropDuplicates(["k"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars (code points), one row for each row.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space. Null html
    counts as empty, and an empty page has an empty text. Null URLs are paths of no host. Repeated rows get the same
    text. Other columns are ignored. Texts aren't cut, whatever their length.
    """
    p = pages.select("page_id", "url", "html").withColumn("_k", F.xxhash64("page_id", "url", "html"))
    gone = cut(deletions(p), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                texts = [" ".join(chosen(candidates(blocks(t or ""))[1], lost or ())) for t, lost in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = p.schema["page_id"].dataType.simpleString()
    with_gone = p.join(gone, F.col("_k") == F.col("k"), "left").select("page_id", "url", "html", "gone") if not gone.isEmpty() else p.select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
    return with_gone.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
