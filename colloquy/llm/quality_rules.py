"""Quality rules: counts of words, symbols and repeats, and divergence from what is usual for the language.

Two histograms of each document, over classes of characters and over its language's common words, are compared with
the same histograms summed over all documents of that language, by Jensen-Shannon distance (base 2, from 0 to 1).
Everything is DataFrame expressions. The references are five rows at most; the documents are read once, their counts
are written down, and nothing is shuffled but those five sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, cut, fresh, let

# Frequent function words, by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Languages without a list share one reference for characters, and their common words aren't judged.
OTHER = ""
# Classes of characters, each a set for a regular expression. What is left is the last class.
# Lower-case ASCII letters and white space come before these.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "stop": r"[.,;:!?'\"()\-]+", "symbol": "[#*$%&|<>]+"}
N_CLASSES = 3 + len(CLASSES)
N_COMMON = len(COMMON_WORDS["en"])


@dataclass(frozen=True)
class Limits:
    """Bounds of the verdict. A histogram is judged only if it has enough characters or words."""

    char_distance: float = 0.25
    word_distance: float = 0.26
    min_chars: int = 200
    min_words: int = 100
    base_words: int = 50
    repeat_percent: int = 50


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window. ``words`` must be a column, not an expression: it is read at each window."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, the first included, from the windows' hashes in text order."""

    def covered(s: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        starts = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _known(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(F.lit(OTHER))


def word_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the language occurs, the other words last: an array of doubles; null without a list."""
    out = F.lit(None).cast("array<double>")
    for code, common in COMMON_WORDS.items():
        out = F.when(lang == code, _histogram(words, common)).otherwise(out)
    return out


def _histogram(words: Column, common: list[str]) -> Column:
    hits = F.filter(words, lambda w: w.isin(common))
    joined = F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" "))
    return let(joined, lambda s: F.array(*[((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("double") for w in common]))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts and one of shares, both arrays; null if nothing is counted."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def scaled(whole: Column) -> Column:
        return F.zip_with(F.transform(counts, lambda x: x / whole), shares, lambda a, b: part(a, b) + part(b, a))

    return F.when(_sum(counts) > 0, F.sqrt(F.greatest(_sum(let(_sum(counts), scaled)) / 2, F.lit(0.0))))


def features(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """The columns ``carry``, then _k (language group), _c (characters by class), _w (common words), and the base counts.

    Each projection reads the arrays that the one before has made, so nothing is computed twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    f = docs.select(*carry, text.alias("_t"), _known(F.col("lang")).alias("_k"), words_of(text).alias("_words"))
    kept = [n for n in f.columns if n not in ("_t", "_words")]
    # Lower-case letters and white space are most of a text; the other classes are counted in what they leave.
    f = f.select("*", window_hashes(F.col("_words")).alias("_h"), F.length(F.array_join("_words", "")).alias("_n"), F.regexp_replace("_t", r"[a-z\x20\x09-\x0D]+", "").alias("_rest"), F.length("_t").alias("_all"), word_counts(F.col("_words"), F.col("_k")).alias("_w"))
    count = lambda name: F.length("_rest") - F.length(F.regexp_replace("_rest", CLASSES[name], ""))
    f = f.select("*", F.size(F.array_distinct("_h")).alias("_kinds"), *[count(n).alias(f"_{n}") for n in CLASSES])
    known = ["_lower", "_space", *[f"_{n}" for n in CLASSES]]
    f = f.withColumns({"_space": F.col("_all") - F.col("_n"), "_lower": F.col("_n") - F.length("_rest")})
    rest = F.col("_all") - sum((F.col(c) for c in known[1:]), F.col(known[0]))
    repeats = F.when(F.col("_kinds") == F.size("_h"), F.lit(0).cast("long")).otherwise(repeat_words(F.col("_h")))
    return f.select(
        *kept, F.array(*[F.col(c).cast("double") for c in known], rest.cast("double")).alias("_c"), F.concat("_w", F.array(F.size("_words") - _sum(F.col("_w")))).alias("_w"),
        F.size("_words").cast("long").alias("n_words"), F.col("_n").cast("long").alias("word_chars"), F.col("_symbol").cast("long").alias("n_symbols"), dup_lines(F.col("_t")).alias("n_dup_lines"), repeats.alias("n_repeat_words"),
    ).select(*kept, "_c", "_w", *named)


def references(f: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Language group -> shares of the character classes and of the common words, over all rows of ``features``.

    A grouped aggregation with one row for each group: at most one more than COMMON_WORDS has languages.
    """
    sums = [F.sum(F.col("_c")[i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.col("_w")[i]).alias(f"w{i}") for i in range(N_COMMON + 1)]
    share = lambda xs: [x / sum(xs) for x in xs] if sum(xs) else [1 / len(xs)] * len(xs)
    return {r["_k"]: (share([r[f"c{i}"] or 0.0 for i in range(N_CLASSES)]), share([r[f"w{i}"] or 0.0 for i in range(N_COMMON + 1)])) for r in f.groupBy("_k").agg(*sums).collect()}


def assess(docs: DataFrame, keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and, named with a leading underscore if taken, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    ``docs`` needs text and lang. base_failed: under ``limits.base_words`` words or over ``repeat_percent`` percent of
    them in repeated 3-word windows. kept: not base_failed and neither histogram further from its reference than
    allowed. A histogram under min_chars or min_words, or of a language without a list of words, isn't judged (distance
    null). Null text counts as empty (base_failed); null or unknown languages share one reference of characters. An
    empty table gives an empty result. Repeated rows are judged each, alike.
    """
    keep = docs.columns if keep is None else keep
    n = {c: f"__{i}" for i, c in enumerate(keep)}
    f = cut(features(docs, [F.col(f"`{c}`").alias(n[c]) for c in keep]), "rules")
    refs = references(f)

    def of(kind: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for k, r in refs.items():
            out = F.when(F.col("_k") == k, F.array(*map(F.lit, r[kind]))).otherwise(out)
        return out

    by_char = F.when(_sum(F.col("_c")) >= limits.min_chars, js_distance(F.col("_c"), of(0)))
    by_word = F.when((F.col("n_words") >= limits.min_words) & F.col("_w").isNotNull(), js_distance(F.col("_w"), of(1)))
    f = f.withColumns({"char_distance": by_char, "word_distance": by_word})
    failed = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    good = ~failed & (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= limits.char_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= limits.word_distance)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    f = f.withColumns({"base_failed": failed, "kept": good})
    return f.select(*[F.col(n[c]).alias(c) for c in keep], *[F.col(x).alias(fresh(keep, x)) for x in made])
