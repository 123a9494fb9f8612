"""Language identification by Bayesian fusion of evidence.

The posterior of a page's language is the normalised product of

* the text's likelihood under character n-gram models, tempered because n-grams of a text aren't independent;
* P(declared markup language | language) and P(address code | language), each estimated over all other pages;
* a prior for the host, smoothed hierarchically: a host's counts shrink to those of its registered domain, these to
  those of its top-level domain, and these to those of all pages, at each level without the page itself.

Host counts and both tables of declared codes are grouped aggregations of the text posteriors over all pages. A page's
own part is taken out of every sum that it is judged by, so that no text counts twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, hot_keys, let, salted
from .html_text import article

#: n-grams are hashed to so many buckets; the model is one number for each bucket and language.
BUCKETS = 2**15
#: Different labelled texts for each language, at most: those with the least hash.
SAMPLE = 1500
#: The bound on the hash is found by counts of its leading bits: so many at a time, so many times.
BITS, LEVELS = 8, 5
#: At most so many languages are told apart; a table of labels with more is an error.
MOST_LANGUAGES = 64
#: A text's log likelihood ratio counts as if it had at most so many independent n-grams.
EFFECTIVE = 60.0
#: Pseudo-counts with which a level of the hierarchy leans on the one above.
STRENGTH = 10.0
#: Pseudo-count of a declared code under each language.
CODE_SMOOTHING = 1.0
WORDS_KEPT = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
HTML_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
META_LANG = re.compile(r"<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
#: Second labels below which names are registered in country domains.
SECOND = {"ac", "co", "com", "edu", "gov", "net", "or", "org"}
NUMERIC = re.compile(r"[0-9.]+|.*:.*")
PATH_CODE = re.compile(r"^/([a-z]{2})(?:[-_][a-zA-Z]{2})?(?:/|$)")


def grams(word: str) -> list[int]:
    """Buckets of a word's 1- to 4-grams with its ends marked."""
    w = f"<{word}>"
    raw = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in raw if x not in "<>"]


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    def score(self, text: str, known: dict[str, tuple[int, np.ndarray]]) -> np.ndarray:
        """Tempered log likelihood of each language, the greatest being 0; all 0 for a text without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for w, c in Counter(LETTERS.findall(text.lower())).items():
            if w not in known:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                g = grams(w)
                known[w] = (len(g), self.log_p[g].sum(axis=0))
            k, s = known[w]
            n += c * k
            total = total + c * s
        if not n:
            return total
        total = total * min(1.0, EFFECTIVE / n)
        return total - total.max()


def _sampled(hashes: DataFrame, counts: dict[str, int], sample: int) -> Column:
    """A filter on lang and h that lets through the ``sample`` rows with the least hash (as an unsigned number) of each
    language, or a few less. ``hashes``: each lang and h once; ``counts``: its rows by language.

    Rows are counted by the leading bits of the hash; only the bucket in which a language's running count passes
    ``sample`` is counted again by the next bits. What is left in that bucket at the end is left out.
    """
    top = lambda bits: F.expr(f"shiftrightunsigned(h, {64 - bits})") if bits else F.lit(0).cast("long")
    prefix, room = {x: 0 for x, n in counts.items() if n > sample}, dict.fromkeys(counts, sample)
    for level in range(LEVELS if prefix else 0):
        mine = F.lit(False)
        for lang, p in prefix.items():
            mine = mine | ((F.col("lang") == lang) & (top(BITS * level) == p))
        found: dict[str, dict[int, int]] = {lang: {} for lang in prefix}
        for r in hashes.where(mine).groupBy("lang", F.pmod(top(BITS * (level + 1)), F.lit(2**BITS)).cast("int").alias("b")).count().collect():
            found[r["lang"]][r["b"]] = r["count"]
        for lang in prefix:
            at = 2**BITS - 1
            for b in sorted(found[lang]):
                if found[lang][b] > room[lang]:
                    at = b
                    break
                room[lang] -= found[lang][b]
            prefix[lang] = prefix[lang] * 2**BITS + at
    keep = F.lit(False)
    for lang in counts:
        keep = keep | ((F.col("lang") == lang) & (top(BITS * LEVELS) < prefix[lang] if lang in prefix else F.lit(True)))
    return keep


def fit_text(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """text, lang -> a model of the languages that occur, from at most ``sample`` different texts of each (whole texts).

    Rows without lang or text aren't used; a text that is repeated counts once. n-grams are counted in the executors;
    one array for each language is collected.
    """
    t = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.xxhash64("text").alias("h"), "text")
    hashes = cut(t.select("lang", "h").distinct(), "label_hashes")
    counts = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    if not counts:
        return TextModel(["und"], np.zeros((BUCKETS, 1)))
    languages = sorted(counts)
    chosen = t.where(_sampled(hashes, counts, sample)).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, c in Counter(LETTERS.findall(text.lower())).items():
                    np.add.at(counts[languages.index(lang)], grams(w), c)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[i, j], pa.int64())], ["l", "bucket", "n"])

    found = chosen.select("lang", "text").mapInArrow(run, "l int, bucket int, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    counts[found["bucket"], found["l"]] += found["n"]
    return TextModel(languages, np.log(counts / counts.sum(axis=0)))


def declared(html: str) -> str | None:
    """The language that the markup declares, lower case, two or three letters."""
    m = HTML_LANG.search(html) or META_LANG.search(html)
    return m.group(1).lower() if m else None


def address(url: str | None) -> tuple[str, str, str, str | None]:
    """Host, registered domain, suffix, and the language code in the address: its path's first part, else a country suffix."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or "").lower(), parts.path
    except ValueError:
        host, path = "", ""
    m = PATH_CODE.match(path)
    if NUMERIC.fullmatch(host):
        return host, host, "", m.group(1) if m else None
    labels = host.split(".")
    suffix = labels[-1] if len(labels) > 1 else ""
    below = 3 if len(suffix) == 2 and labels[-2] in SECOND else 2
    return host, ".".join(labels[-below:]), suffix, m.group(1) if m else suffix if len(suffix) == 2 else None


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, code, text (log likelihoods): all that fusion needs of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                where = [address(u) for u in batch.column(1).to_pylist()]
                pages_ = [t or "" for t in batch.column(2).to_pylist()]
                text = [model.score(article(t), known) for t in pages_]
                cols = [pa.array(x, pa.string()) for x in zip(*where, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols[:3], pa.array([declared(t) for t in pages_], pa.string()), cols[3], pa.array([x.tolist() for x in text], pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "code", "text"])

    few = pages.select("page_id", "url", "html")
    return few.mapInArrow(run, f"page_id {few.schema['page_id'].dataType.simpleString()}, host string, domain string, suffix string, declared string, code string, text array<double>")


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v))
    return let(e, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s)))


def _sums(df: DataFrame, by: list[str], of: str, n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.array(*[F.sum(F.col(of)[i]) for i in range(n)]).alias("sums"), F.count("*").alias("n"))


def _less(sums: Column, own: Column) -> Column:
    return F.zip_with(sums, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def _smooth(sums: Column, above: Column) -> Column:
    whole = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    return let(whole, lambda s: F.zip_with(sums, above, lambda a, b: (a + STRENGTH * b) / (s + STRENGTH)))


def identify(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang (most probable, ties to the first by name), confidence, text_lang, declared, code, host.

    ``pages``: page_id, url, html; ``labelled``: text, lang. Pages without letters are judged by their other evidence;
    null html and url count as empty. Repeated rows are judged each. Other columns are ignored. Texts are read whole,
    whatever their length. Empty pages give an empty result; without labels every page is "und".
    """
    model = fit_text(labelled, sample)
    n = len(model.languages)
    e = cut(evidence(pages, model), "evidence").withColumn("p", _softmax(F.col("text")))
    total = e.agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)], F.count("*").alias("n")).first()
    world = F.array(*[F.lit(float(total[i] or 0.0)) for i in range(n)])
    # Sums of hosts, domains and suffixes. Their numbers grow with the data, so they are joined; one domain may have most
    # of the hosts, and one suffix most of the domains.
    hosts = cut(_sums(e, ["host", "domain", "suffix"], "p", n), "hosts")
    up = lambda of, by, name: of.groupBy(*by).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"), F.count("*").alias("n")).withColumnRenamed("sums", name)
    domains = cut(up(hosts, ["domain", "suffix"], "of_domain"), "domains")
    suffixes = cut(up(domains.withColumnRenamed("of_domain", "sums"), ["suffix"], "of_suffix"), "suffixes")
    above = salted(domains, suffixes.select("suffix", "of_suffix"), "suffix", hot_keys(suffixes, "suffix", "n"), F.xxhash64("domain"))
    priors = salted(hosts.withColumnRenamed("sums", "of_host"), above.select("domain", "of_domain", "of_suffix"), "domain", hot_keys(domains, "domain", "n"), F.xxhash64("host"))
    priors = cut(priors.select("host", "n", "of_host", "of_domain", "of_suffix"), "priors")

    def with_code(df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with ``name``: log P(code | language) of each language. Codes have two or three letters: at most 18,252."""
        rows = _sums(e.where(F.col(column).isNotNull()), [column], "p", n).collect()
        whole = np.array([r["sums"] for r in rows]).reshape(len(rows), n).sum(axis=0)
        known = df.sparkSession.createDataFrame([(r[column], list(r["sums"])) for r in rows], "c string, v array<double>")
        found = df.join(F.broadcast(known), F.col(column) == F.col("c"), "left")
        log = F.array(*[F.log((F.greatest(F.col("v")[i] - F.col("p")[i], F.lit(0.0)) + CODE_SMOOTHING) / (F.greatest(F.lit(float(whole[i])) - F.col("p")[i], F.lit(0.0)) + CODE_SMOOTHING * (len(rows) + 1))) for i in range(n)])
        return found.withColumn(name, F.when(F.col("v").isNotNull(), log).otherwise(F.array(*[F.lit(0.0)] * n))).drop("c", "v")

    e = with_code(with_code(e, "declared", "d"), "code", "a")
    e = salted(e, priors.drop("n"), "host", hot_keys(priors, "host", "n"), F.xxhash64("page_id", "declared", "code", "text"))
    own = F.col("p")
    base = F.transform(_less(world, own), lambda x: (x + 1.0) / F.lit(float(max((total["n"] or 0) - 1, 0) + n)))
    e = e.withColumn("prior", _smooth(_less(F.col("of_host"), own), _smooth(_less(F.col("of_domain"), own), _smooth(_less(F.col("of_suffix"), own), base))))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    whole = add(add(F.col("text"), F.transform("prior", lambda x: F.log(x))), add(F.col("d"), F.col("a")))
    e = e.withColumn("posterior", _softmax(let_max(whole)))
    names = F.array(*map(F.lit, model.languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    by_text = F.when(F.exists("text", lambda x: x != 0), best(F.col("p")))
    return e.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), by_text.alias("text_lang"), "declared", "code", "host")


def let_max(x: Column) -> Column:
    """``x`` less its greatest element."""
    return let(x, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda a: a - m)))
