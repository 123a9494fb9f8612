"""Source divergence audit by a baseline-correction inverted index.

Each language has a vocabulary, and each source of a language a smoothed distribution over it. How far one source is from
another is a sum over the whole vocabulary, of which nearly all terms are absent from both. So each pair starts at V times
the value of a term that neither has, and is then corrected:

* for terms that one of the two has, by the histogram of that source's counts (terms with equal counts give equal
  corrections, whatever the terms are);
* for terms that both have, by the postings: a term's posting holds the sources that have it, and gives a row for each two
  of them. Rows of equal counts are added up before they are shuffled.

No row is made for a term that a source lacks. All values are integers, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Terms are runs of ASCII letters and of anything beyond ASCII: by byte, A-Z to a-z, the rest of ASCII to spaces.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Texts whose words are counted at once, which takes some 25 times their bytes where all words differ; and rows sent at
#: once. In 64 bits, a text of 2 GB leaves place for 2^14 rows.
SLICE_BYTES, SLICE_ROWS, SENT_ROWS = 1 << 24, 1 << 14, 1 << 16
#: A term counts if at least so many documents of its language have it; terms that are reported for each source.
LEAST_DOCS, MOST_TERMS = 3, 200
#: Counts from here on, times 10^9, don't fit a long: they are divided as decimals.
WIDE = 9_000_000_000


def probability(count: str, total: str) -> str:
    """1 + floor(10^9 (count + 1) / total), exactly."""
    return f"(1 + CASE WHEN {count} < {WIDE - 1} THEN (1000000000 * ({count} + 1)) div ({total}) ELSE (cast({count} + 1 AS DECIMAL(19, 0)) * cast(1000000000 AS DECIMAL(10, 0))) div cast({total} AS DECIMAL(19, 0)) END)"


def value(p: str, q: str) -> str:
    """floor((p - q)^2 / q). Neither exceeds 10^9 + 1, so the square fits a long, and so do sums over a vocabulary."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and lengths of stretches of ``SLICE_BYTES`` (the last text may exceed them) and of ``SLICE_ROWS`` at most."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held >= SLICE_BYTES or i - start == SLICE_ROWS:
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def words(text: pa.Array) -> pa.ListArray:
    """The terms of each text, with empty strings between some: a byte that is no term's is a space, A-Z are small letters.

    Bytes of characters beyond ASCII are all 128 or more, so this needs no decoding.
    """
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2]
    data = held[int(ends[0]) : int(ends[-1])].to_pybytes() if held else b""
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), pa.py_buffer(ends - ends[0]), pa.py_buffer(data.translate(FOLD))))


def begins(keys: np.ndarray) -> np.ndarray:
    """Whether each of these sorted keys is the first of its run."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, text -> lang, source, term, n, docs, a row for each term of a group of these texts.

    A word is one number, of its group, its term and its text; once they are sorted, counts are the lengths of runs.
    """
    found = words(batch.column("text").cast(pa.string()))
    term = found.values.dictionary_encode()
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    _, row, group = np.unique(lang.indices.to_numpy() * np.int64(batch.num_rows) + source.indices.to_numpy(), return_index=True, return_inverse=True)
    a, b = len(term.dictionary).bit_length(), batch.num_rows.bit_length()
    each = term.indices.to_numpy().astype(np.int64)
    each <<= b
    each |= np.repeat(group << (a + b) | np.arange(batch.num_rows), found.value_lengths().to_numpy())
    none = pc.index(term.dictionary, "").as_py()
    if none >= 0:
        each = each[term.indices.to_numpy() != none]
    each.sort()
    first = begins(each)
    each >>= b
    at = np.flatnonzero(begins(each))
    docs = np.add.reduceat(first, at, dtype=np.int64) if len(at) else at
    kind = each[at]
    of = pa.array(row[kind >> a])
    columns = [batch.column("lang").take(of), batch.column("source").take(of), term.dictionary.take(pa.array(kind & ((1 << a) - 1))), pa.array(np.diff(at, append=len(each))), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); dealt by lang and term.

    A task counts the words of a slice of its texts, of which Spark shuffles the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(pc.binary_length(batch.column("text")).to_numpy()):
                got = counted(batch.slice(start, n))
                yield from (got.slice(i, SENT_ROWS) for i in range(0, got.num_rows, SENT_ROWS))

    few = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = few.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n, posting: the kept terms of each language, each with its sources and their counts in order of source.

    A posting has at most as many entries as the language has sources, as has each source's part of the result.
    """
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("posting"))
    return found.where(F.col("docs") >= least_docs).drop("docs")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) that ``docs`` (text, lang, source) has, its divergence
    from every other source of the language (part pair), and the ``most_terms`` terms that it uses more than its language
    does, by how much they stand out (part term); the greatest first, ties by item.

    Null text, lang and source are read as ''. Groups without terms are there, with counts of zero. Where a language keeps
    no term, its pairs are 0. Repeated rows count as often as they are there. Other columns are ignored; an empty table
    gives an empty result.
    """
    index = cut(postings(docs, least_docs), "postings")
    entries = index.select("lang", "term", F.col("n").alias("m"), F.explode("posting").alias("e")).select("lang", "term", "m", "e.source", "e.n")
    hist = cut(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "histogram")
    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("m_all"))
    present = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n_all"))
    groups = present.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "m_all", "n_all"])
    # A row for each source of each language. Whether it is broadcast, Spark decides by the size of what was written.
    groups = cut(groups.select("lang", "source", "v", (F.col("m_all") + F.col("v")).alias("m_all"), (F.col("n_all") + F.col("v")).alias("n_all")), "groups")

    a = groups.select("lang", "v", F.col("source").alias("a"), F.col("n_all").alias("na"))
    pairs = a.join(groups.select("lang", F.col("source").alias("b"), F.col("n_all").alias("nb")), "lang").where("a <> b")
    p0, q0 = probability("0L", "na"), probability("0L", "nb")
    zero = value("p0", "q0")
    start = pairs.where("v > 0").selectExpr("*", f"{p0} AS p0", f"{q0} AS q0")
    base = start.selectExpr("lang", "a", "b", f"v * {zero} AS x").unionByName(pairs.where("v = 0").selectExpr("lang", "a", "b", "0L AS x"))
    # Terms that a has, as if b had none of them; and the other way round.
    mine = start.join(hist.withColumnRenamed("source", "a"), ["lang", "a"]).selectExpr("lang", "a", "b", f"terms * ({value(probability('n', 'na'), 'q0')} - {zero}) AS x")
    others = start.join(hist.withColumnRenamed("source", "b"), ["lang", "b"]).selectExpr("lang", "a", "b", f"terms * ({value('p0', probability('n', 'nb'))} - {zero}) AS x")
    # Terms that both have: what is right, less what was taken for each of the two.
    first = index.select("lang", "posting", F.posexplode("posting").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.slice("posting", F.col("i") + 2, F.size("posting"))).alias("y")).groupBy("lang", F.col("x.source").alias("s"), F.col("y.source").alias("t"), F.col("x.n").alias("ns"), F.col("y.n").alias("nt")).agg(F.count("*").alias("terms"))
    both = both.select("lang", "terms", F.explode(F.array(*[F.struct(F.col(s).alias("a"), F.col(t).alias("b"), F.col(m).alias("ca"), F.col(n).alias("cb")) for s, t, m, n in (("s", "t", "ns", "nt"), ("t", "s", "nt", "ns"))])).alias("z")).select("lang", "terms", "z.*")
    joint = both.join(start, ["lang", "a", "b"]).selectExpr("lang", "a", "b", "terms", "p0", "q0", f"{probability('ca', 'na')} AS p", f"{probability('cb', 'nb')} AS q")
    joint = joint.selectExpr("lang", "a", "b", f"terms * ({value('p', 'q')} - {value('p', 'q0')} - {value('p0', 'q')} + {zero}) AS x")
    apart = base.unionByName(mine).unionByName(others).unionByName(joint).groupBy("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item")).agg(F.sum("x").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(order))
    above = entries.join(groups, ["lang", "source"]).selectExpr("lang", "source", "term AS item", f"{probability('n', 'n_all')} AS p", f"{probability('m', 'm_all')} AS q").where("p > q")
    above = above.selectExpr("lang", "source", "'term' AS part", "item", f"{value('p', 'q')} AS value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return apart.unionByName(above)
