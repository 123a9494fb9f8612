"""URL filters: rules first, then two character models of URLs that the rules accept and reject.

The models are Markov models of variable order over host and path: the probability of a character after the longest part
of its context that was seen, each order smoothed by the next shorter one (Witten and Bell). Everything that they need
of a position is its window, the last ``WIDTH`` characters. So windows are counted once for each class, shorter contexts are sums
of longer ones, and the logarithm of the ratio of the two models is one table of windows; a URL's score is the mean of its
windows' entries. The threshold is the score that best separates accepted from rejected URLs, each judged by a model that
was fitted without it. Only DataFrame functions; logarithms are rounded to 10^-6, so sums are exact.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, fresh, hot_keys, salted

#: Characters of a window: the one that is judged, and the longest context before it.
WIDTH = 5
#: What a character counts for in the shortest context.
UNSEEN = 1 / 256
#: Windows that hold at least one position in so many are hot: there are at most so many, so they are broadcast.
HOT_WINDOWS = 4096
#: Steps of the threshold: so many for each unit of the score.
STEPS = 100
MICRO = 1_000_000
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, '' where there are none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long ones that with the longer host
    comes first, then by text, then block before allow."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text, r.verdict == "block")):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def windows(texts: DataFrame) -> DataFrame:
    """``texts`` (.., text) with a row for each character of a text and for its end: window."""
    padded = F.concat(F.lit(START * (WIDTH - 1)), F.col("text"), F.lit(END))
    names = [c for c in texts.columns if c != "text"]
    each = texts.select(*names, padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("i"))
    return each.select(*names, F.substring(F.col("padded"), F.col("i"), F.lit(WIDTH)).alias("window"))


#: Counts by class (accepted, rejected) and fold (0, 1), and the models that are made of them: all, without fold 0, without fold 1.
COUNTS = ("a0", "a1", "r0", "r1")
MODELS = {"a_all": "a0 + a1", "a_without0": "a1", "a_without1": "a0", "r_all": "r0 + r1", "r_without0": "r1", "r_without1": "r0"}


def log_ratios(counted: DataFrame) -> DataFrame:
    """window, all_, without0, without1: 10^6 times the logarithm of accepted by rejected, for each window of ``counted``
    (window and COUNTS)."""
    shorter = None
    for k in range(1, WIDTH + 1):
        gram = F.substring(F.col("window"), WIDTH - k + 1, k)
        grams = counted.groupBy(gram.alias("gram")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        grams = grams.select("gram", *[F.expr(body).alias(m) for m, body in MODELS.items()])
        context = Window.partitionBy(F.substring(F.col("gram"), 1, k - 1))  # at most as many rows as there are characters
        grams = grams.select("*", *[F.sum(m).over(context).alias(f"n_{m}") for m in MODELS], *[F.sum((F.col(m) > 0).cast("long")).over(context).alias(f"t_{m}") for m in MODELS])
        if shorter is None:
            before = grams.select("*", *[F.lit(UNSEEN).alias(f"p_{m}") for m in MODELS])
        else:
            before = grams.withColumn("suffix", F.substring(F.col("gram"), 2, k)).join(shorter, "suffix")
        mixed = [F.when(F.col(f"n_{m}") == 0, F.col(f"p_{m}")).otherwise((F.col(m) + F.col(f"t_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"t_{m}"))) for m in MODELS]
        shorter = before.select(F.col("gram").alias("suffix"), *[x.alias(f"p_{m}") for x, m in zip(mixed, MODELS, strict=True)])
    ratio = lambda m: F.floor(F.log(F.col(f"p_a_{m}") / F.col(f"p_r_{m}")) * MICRO + 0.5).cast("long")
    return shorter.select(F.col("suffix").alias("window"), ratio("all").alias("all_"), ratio("without0").alias("without0"), ratio("without1").alias("without1"))


def threshold(scored: DataFrame) -> float | None:
    """The score from which on URLs are accepted, from accepted and rejected ones (verdict, held_out): the step with the
    largest sum of the shares that are judged right; ties to the one nearest to 0, then the smaller. None without both.

    Steps are as many as there are different scores in hundredths: at most a few thousand rows.
    """
    steps = scored.groupBy(F.floor(F.col("held_out") * STEPS).alias("step")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("good"), F.sum((F.col("verdict") == "block").cast("long")).alias("bad"))
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    judged = steps.select("step", F.sum("good").over(whole).alias("goods"), F.sum("bad").over(whole).alias("bads"), F.coalesce(F.sum("good").over(upto), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(upto), F.lit(0)).alias("caught"))
    best = judged.where("goods > 0 AND bads > 0").select("step", ((F.col("goods") - F.col("lost")) * F.col("bads") + F.col("caught") * F.col("goods")).alias("right")).orderBy(F.desc("right"), F.abs("step"), "step").first()
    return None if best is None else best["step"] / STEPS


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (url; of the other columns those in ``keep``, by default all) with host, path, rule, verdict (allow or
    block) and score, each under a name that isn't taken.

    Verdicts are those of the longest rule that fits; where none fits, that of the models: allow from the threshold on.
    Models see each (host, path) once, however often it is there, and URLs that differ in neither are judged alike. Score is
    the mean logarithm of the ratio by character, null where a rule decides. A null URL, or one without ``://``, has an empty
    host and path. If the rules accept or reject nothing at all, there is nothing to learn from, and the rest is allowed.
    Empty tables give empty results.
    """
    keep = [c for c in pages.columns] if keep is None else keep
    names: dict[str, str] = {}
    for c in ("host", "path", "rule", "verdict", "score"):
        names[c] = fresh([*keep, *names.values()], c)
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("kept", "host", "path", F.md5(F.concat("host", F.lit("\0"), "path")).alias("key"), name.alias("rule"), verdict.alias("verdict"))
    urls = cut(rows.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("verdict").alias("verdict"), F.count("*").alias("n")), "urls")
    texts = urls.select("key", "verdict", F.concat("host", "path").alias("text"), (F.substring("key", 1, 1) >= "8").cast("int").alias("fold"))

    positions = windows(texts.select("verdict", "fold", "text"))
    of = lambda v, f: F.sum(((F.col("verdict") == v) & (F.col("fold") == f)).cast("long"))
    counted = positions.groupBy("window").agg(F.count("*").alias("n"), *[F.coalesce(of(v, f), F.lit(0)).alias(c) for c, (v, f) in zip(COUNTS, (("allow", 0), ("allow", 1), ("block", 0), ("block", 1)), strict=True)])
    counted = cut(counted, "windows")
    total = counted.agg(F.sum("n")).first()[0] or 0
    ratios = cut(log_ratios(counted).join(counted.select("window", "n"), "window"), "ratios")
    hot = (F.col("n") * HOT_WINDOWS >= total) & (F.col("n") > 0)
    few, rest = ratios.where(hot).drop("n"), ratios.where(~hot).drop("n")
    asked = windows(texts.select("key", F.length("text").alias("size"), "verdict", "fold", "text"))
    held = F.when(F.col("fold") == 0, F.col("without0")).otherwise(F.col("without1"))
    near = asked.join(F.broadcast(few), "window")
    far = asked.join(F.broadcast(few.select("window")), "window", "left_anti").join(rest, "window")
    sums = near.unionByName(far).groupBy("key").agg(F.first("verdict").alias("verdict"), F.first("size").alias("size"), F.sum("all_").alias("x"), F.sum(held).alias("y"))
    scored = cut(sums.select("key", "verdict", (F.col("x") / (F.col("size") + 1) / MICRO).alias("score"), (F.col("y") / (F.col("size") + 1) / MICRO).alias("held_out")), "scores")

    least = threshold(scored.where("verdict IS NOT NULL"))
    heavy = hot_keys(urls.where("verdict IS NULL").select("key", "n"), "key", "n")
    out = salted(rows.where("verdict IS NULL").drop("verdict"), scored.where("verdict IS NULL").select("key", "score"), "key", heavy, F.monotonically_increasing_id(), "left")
    learned = F.lit("allow") if least is None else F.when(F.col("score") >= least, "allow").otherwise("block")
    done = rows.where("verdict IS NOT NULL").select("kept", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    both = done.unionByName(out.select("kept", "host", "path", "rule", learned.alias("verdict"), "score"))
    return both.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *[F.col(c).alias(n) for c, n in names.items()])
