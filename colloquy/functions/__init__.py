"""Column functions over texts that need more than a pattern: runs of repeated words, edit distance over words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import sequences

WIDEST = 4
#: A loop: this many words at least, a run of this many units, this share of the words in runs of three or more.
LOOP_WORDS, LOOP_RUN, LOOP_SHARE = 10, 5, 0.6


def let(value: Column, body) -> Column:
    """``body`` over ``value`` as a lambda variable, so that ``value`` is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case words between white space, without punctuation at their ends."""
    raw = F.transform(F.split(F.lower(text), r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", ""))
    return F.filter(raw, lambda w: w != "")


def canonical(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces; other characters vanish without splitting a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} \t\n\r]", ""), r"[ \t\n\r]+", " "))


def _stretches(w: Column, n: int) -> Column:
    """Where word i equals word i - n: (start, length) of each stretch of such places that is n long at least.

    A sequence of n words is repeated back to back k times where such a stretch is at least (k - 1) * n long, whatever
    the phase, so one pass over the words finds all runs of it.
    """
    kind = "struct<at:int,len:int,found:array<struct<s:int,l:int>>>"
    close = lambda a: F.when(a["len"] >= n, F.concat(a["found"], F.array(F.struct(a["at"].alias("s"), a["len"].alias("l"))))).otherwise(a["found"])
    step = lambda a, i: F.when(F.get(w, i) == F.get(w, i - n), F.struct(F.when(a["len"] == 0, i).otherwise(a["at"]).alias("at"), (a["len"] + 1).alias("len"), a["found"].alias("found"))).otherwise(F.struct(i.alias("at"), F.lit(0).alias("len"), close(a).alias("found")))
    places = F.when(F.size(w) > n, F.sequence(F.lit(n), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.array().cast("array<struct<s:int,l:int>>").alias("found")).cast(kind)
    return F.aggregate(places, start, lambda a, i: step(a, i).cast(kind), close)


def runs(w: Column) -> Column:
    """Of the sequences of 1 to 4 words: how often the one that is repeated most comes in a row (1 without repeats), and how
    many words are in runs of three or more."""

    def repeated(n: int) -> Column:
        return F.transform(_stretches(w, n), lambda x: F.struct((F.floor(x["l"] / F.lit(n)) + 1).cast("int").alias("run"), (x["s"] - n).alias("a"), (x["s"] + x["l"] - 1).alias("b")))

    found = F.array(*map(repeated, range(1, WIDEST + 1)))
    covered = lambda x: F.size(F.array_distinct(F.flatten(F.transform(F.filter(x, lambda r: r["run"] >= 3), lambda r: F.sequence(r["a"], r["b"])))))
    return let(F.flatten(found), lambda x: F.struct(F.coalesce(F.array_max(F.transform(x, lambda r: r["run"])), F.lit(1)).alias("run"), covered(x).alias("covered")))


def longest_run(text: Column) -> Column:
    """The most times in a row that any sequence of 1 to 4 words occurs; 1 for an empty text."""
    return let(words(text), lambda w: runs(w)["run"])


def runaway(text: Column) -> Column:
    """Whether runs of repeated words make up most of a text."""
    return let(words(text), lambda w: let(runs(w), lambda r: (F.size(w) >= LOOP_WORDS) & (r["run"] >= LOOP_RUN) & (r["covered"] >= LOOP_SHARE * F.size(w))))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    code: dict = {}
    x = np.array([code.setdefault(v, len(code)) for v in a], dtype=np.int64)
    y = np.array([code.setdefault(v, len(code)) for v in b], dtype=np.int64)
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, v in enumerate(x):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (y != v), out=new[1:])
        row = np.minimum.accumulate(new - place) + place  # insertions along the row
    return int(row[-1])


def _distances(a: pd.Series, b: pd.Series, coded) -> pd.Series:
    there = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    one, other = a.iloc[there].tolist(), b.iloc[there].tolist()
    out = pd.Series([pd.NA] * len(a), dtype="Int64")
    numbers = coded(one + other)
    out.iloc[there] = sequences.edit_distances(numbers[: len(there)], numbers[len(there) :])
    return out


@F.pandas_udf(LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance between two arrays of words, in batches (no built-in function compares arrays this way)."""
    return _distances(a, b, sequences.coded)


@F.pandas_udf(LongType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance between two texts, as levenshtein, but a step for 64 cells of its table."""
    return _distances(a, b, lambda texts: list(map(sequences.points, texts)))
