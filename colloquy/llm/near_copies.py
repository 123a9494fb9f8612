"""Near-duplicate documents by order MinHash, verified by banded alignment.

Sketch: every 5-word shingle is labelled with its occurrence number, and under each of SKETCHES hash functions the
TUPLE least of them are kept in the order in which they stand in the text. Two texts agree in a sketch with a
probability that falls with their edit similarity: at the threshold of 0.8 it is about 0.8 ** 4, so all 24 differ
three times in a million pairs.

Candidates: in a bucket, all texts with a sketch in common, each text is compared with one leader, not with every
other. Links join texts into classes. Texts of buckets that still hold several classes are then joined exactly: two
texts that are similar enough share one of the first shingles of each, in an order from rare to common, and have enough
shingles left behind it (prefix and positional filters, which lose no pair). All such pairs of different classes are
compared, so no link between texts of an open bucket is missed. Pairs whose lengths alone keep them under the threshold
aren't compared.

Verification: a longest common subsequence of the two shingle sequences, within the band that the threshold allows.
similarity = common / (all of one + all of the other - common). Exact copies are one text from the start.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, hot_keys, salted

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, TUPLE = 24, 4
#: Orders by which buckets choose their leaders.
ORDERS = 4
#: Texts that are looked at for the common shingles, and how many of those are put last. Both only set the order.
ORDER_TEXTS, ORDER_SHINGLES = 16384, 1 << 16
_RNG = np.random.default_rng(20240101)
_XOR = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str) -> np.ndarray:
    """A 64-bit hash of each 5-word shingle; of the whole for fewer words (one for none at all)."""
    from xxhash import xxh64_intdigest

    words = text.split()
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    s = np.full(n, len(w) if len(w) < SHINGLE else 0, dtype=np.uint64)
    for i in range(min(SHINGLE, len(w))):
        s = s * _MIX + w[i : i + n]
        s ^= s >> np.uint64(29)
    return s * _STEP


def labelled(s: np.ndarray) -> np.ndarray:
    """The hashes with their occurrence numbers mixed in, so that no two are equal but by chance."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    if new.all():
        return s
    start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    out[order] = t + (np.arange(len(t)) - start).astype(np.uint64) * _STEP
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys of a shingle sequence."""
    x = labelled(s)
    k = min(TUPLE, len(x))
    y = (x[None, :] ^ _XOR[:, None]) * _ODD[:, None]
    y ^= y >> np.uint64(32)
    at = np.sort(np.argpartition(y, k - 1, axis=1)[:, :k], axis=1)
    keys = _XOR.copy()
    for i in range(k):
        keys = (keys ^ x[at[:, i]]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


#: Matches for each place of the two sequences up to which they are listed one by one; beyond, rows of bits stand for them.
LISTED = 16
#: Rows of the alignment between two shifts of the window of bits.
ROWS = 512


def matches(a: np.ndarray, b: np.ndarray, band: int, most: int) -> np.ndarray | None:
    """Places j of ``b`` that equal a place i of ``a`` with abs(i - j) <= band: by rising i, then by falling j.

    None if there are more than ``most`` equal pairs, in or out of the band.
    """
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    total = int(n.sum())
    if total > most:
        return None
    i = np.repeat(np.arange(len(a)), n)
    # The places of one value are in rising order; they are taken from the last to the first.
    j = order[np.repeat(hi, n) - 1 - (np.arange(total) - np.repeat(np.cumsum(n) - n, n))]
    return j[np.abs(i - j) <= band]


def common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The length of a longest common subsequence of ``a`` and ``b`` by pairs of places at most ``band`` apart.

    Few matches: the longest rising subsequence of their places. Many: rows of the alignment as integers of the bits in
    the band (a window of 2 * band + ROWS bits, which may find matches a little beyond the band, never a longer one than
    there is), a clear bit where the length grows.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    listed = matches(a, b, band, LISTED * (len(a) + len(b)))
    if listed is not None:
        last: list[int] = []
        for j in listed.tolist():
            k = bisect_left(last, j)
            if k == len(last):
                last.append(j)
            else:
                last[k] = j
        return head + tail + len(last)
    where: dict[int, list[int]] = {}
    for j, value in enumerate(b.tolist()):
        where.setdefault(value, []).append(j)
    grown, low, width = 0, 0, 2 * band + ROWS
    full = row = (1 << width) - 1
    for i, value in enumerate(a.tolist()):
        if i - band - low >= ROWS:
            # The bits that leave the window are done with.
            gone = i - band - low
            grown += gone - (row & ((1 << gone) - 1)).bit_count()
            low += gone
            row = row >> gone | (full >> (width - gone)) << (width - gone)
        places = where.get(value)
        if places:
            hit = 0
            for j in places[bisect_left(places, low) : bisect_left(places, low + width)]:
                hit |= 1 << (j - low)
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return head + tail + grown + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """common / union of two shingle sequences; 0 as soon as it can't reach ``least``."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    # common >= least / (1 + least) * (n + m), so at most n + m - 2 * common places are skipped.
    c = common(a, b, int((n + m) * (1 - least) / (1 + least)) + 1)
    return c / (n + m - c)


def sequence(s: np.ndarray) -> np.ndarray:
    """What alignments compare: 32 bits of each shingle. Two different shingles of a pair of texts are taken for equal
    with a probability of 1 in 4 billion, so even in texts of 20,000 words that is less than one place in ten pairs."""
    return (s >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (MD5 of the text), keys, seq (the shingles, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                s = [shingles(t) for t in batch.column(2).to_pylist()]
                keys = np.concatenate([sketch(x) for x in s]) if s else np.array([], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * SKETCHES), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([sequence(x).tobytes() for x in s], pa.binary())], ["doc_id", "t", "keys", "seq"])

    text = F.coalesce(F.col("text"), F.lit(""))
    few = docs.select("doc_id", text_key(text).alias("t"), text.alias("text"))
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, t binary, keys array<bigint>, seq binary")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def verify(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """t, leader -> those that are similar enough. One text may be in a third of all pairs, on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            ok = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least for x, y in zip(a, b, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["t", "leader"])

    both = pairs
    for key, other, name in (("t", "leader", "a"), ("leader", "t", "b")):
        heavy = hot_keys(pairs.groupBy(key).agg(F.count("*").alias("n")), key, "n")
        both = salted(both, seqs.select(F.col("t").alias(key), F.col("seq").alias(name)), key, heavy, F.xxhash64(other))
    return both.select("t", "leader", "a", "b").mapInArrow(run, "t binary, leader binary")


def unpacked(seq: bytes) -> np.ndarray:
    """The shingles of a packed sequence with their occurrence numbers, as numbers to join by."""
    return labelled(np.frombuffer(seq, np.uint32).astype(np.uint64) * _STEP).view(np.int64)


def common_shingles(texts: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several of a share of ``texts`` (t, seq) hold, and in how many: what prefixes put last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(seq))], ["s"])

    few = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else texts
    n = few.select("seq").mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    got = n.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).toArrow().sort_by("s")  # 16 bytes for each shingle
    return got["s"].to_numpy(), got["n"].to_numpy()


def prefix_length(n: int, least: float) -> int:
    """So many shingles of n, in any one order, hold one that every text with a similarity of ``least`` has there too."""
    return n - max(1, int(np.ceil(least * n - 1e-9))) + 1


def prefixes(texts: DataFrame, common_: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """t, c, seq -> t, c, size, s, place: the first shingles of each text from rare to common, and their places from 0."""
    known, times = common_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c, seq in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = unpacked(seq)
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, times[at], 0)
                k = prefix_length(len(x), least)
                s = x[np.lexsort((x, rank))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([t] * k, pa.binary()), pa.array([c] * k, pa.binary()), pa.array(np.full(k, len(x), np.int32)), pa.array(s), pa.array(np.arange(k, dtype=np.int32))], ["t", "c", "size", "s", "place"])

    return texts.select("t", "c", "seq").mapInArrow(run, "t binary, c binary, size int, s bigint, place int")


def cross_pairs(texts: DataFrame, n: int, least: float) -> DataFrame:
    """t, c, seq (``n`` rows) -> t, leader: each pair of texts of different classes that can have a similarity of ``least``.

    One text of such a pair isn't of the greatest class among those that share the shingle, so members of that class
    are joined with the others only.
    """
    p = cut(prefixes(texts, common_shingles(texts, min(1.0, ORDER_TEXTS / max(n, 1))), least), "prefixes")
    each = p.groupBy("s", "c").agg(F.count("*").alias("n"))
    top = cut(each.groupBy("s").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("all")).where("k > 1").select("s", F.col("m.c").alias("top"), "all"), "shingles")
    heavy = hot_keys(top, "s", "all")
    p = cut(salted(p, top.select("s", "top"), "s", heavy, F.xxhash64("t")), "shared_shingles")
    minor = p.where("c != top").select("s", F.col("t").alias("leader"), F.col("c").alias("cl"), F.col("size").alias("other"), F.col("place").alias("at"))
    # The shared shingle and what is behind it in both must come to the overlap that the threshold asks for.
    reach = F.least(F.col("size") - F.col("place"), F.col("other") - F.col("at")) >= F.lit(least / (1 + least)) * (F.col("size") + F.col("other")) - 1e-6
    once = (F.col("c") == F.col("top")) | (F.col("t") < F.col("leader"))
    pairs = salted(p, minor, "s", heavy, F.xxhash64("t")).where((F.col("c") != F.col("cl")) & once & reach)
    return pairs.select(F.least("t", "leader").alias("t"), F.greatest("t", "leader").alias("leader")).distinct()


def components(links: DataFrame) -> DataFrame:
    """a, b -> v, c: for each end of a link the least member of its component.

    A step takes the least label among the neighbours, and, from the third step on, the label of that label, so that a
    chain is halved each time: steps grow with the logarithm of its length. Families of copies are stars for the most
    part and need two. Each step is written down.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    heavy = hot_keys(both.groupBy("a").agg(F.count("*").alias("n")), "a", "n")
    label = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("c")), "labels")
    step = 0
    while True:
        step += 1
        near = salted(both, label.select(F.col("v").alias("a"), "c"), "a", heavy, F.xxhash64("b")).groupBy(F.col("b").alias("v")).agg(F.min("c").alias("d"))
        new = cut(label.join(near, "v").select("v", F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("v", "c")
        label = new.select("v", "c")
        if step > 2:
            h = hot_keys(label.groupBy("c").agg(F.count("*").alias("n")), "c", "n")
            label = cut(salted(label, label.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", h, F.xxhash64("v")).select("v", F.col("to").alias("c")), "labels")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text -> doc_id, t (MD5 of the text), class_id (the least doc_id of the class), one row for each row.

    Classes are the components of links between texts with a similarity of ``least`` or more. Null text counts as empty;
    texts without words are copies of each other. Null ids come after others: class_id is null only if all of a class
    are. Rows that repeat an id are members each. Other columns are ignored. Empty tables give empty results.
    """
    sk = cut(sketches(docs), "sketches")
    texts = cut(sk.groupBy("t").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first(F.octet_length("seq")).alias("size")), "texts")
    rows = texts.select("t", "size", F.explode("keys").alias("key"))
    # The leader of a bucket is its least text by one of ORDERS hashes, so that buckets of one family have few leaders.
    first = F.min(F.struct(F.xxhash64("t", F.pmod("key", F.lit(ORDERS))).alias("o"), "t", "size")).alias("m")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1").select("key", "n", F.col("m.t").alias("leader"), F.col("m.size").alias("other"))
    shared = cut(shared, "shared")
    heavy_keys = hot_keys(shared, "key", "n")
    buckets = cut(salted(rows, shared.drop("n"), "key", heavy_keys, F.xxhash64("t")), "buckets")
    # Sequences of the texts that are in some bucket, one row for each; all other rows end here.
    wanted = buckets.select(F.col("t").alias("t2")).distinct().join(texts.select(F.col("t").alias("t3"), "doc"), F.col("t2") == F.col("t3")).select("t2", "doc")
    seqs = sk.select("t", F.col("doc_id").alias("id"), "seq").join(wanted, (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("doc"))).select("t", "id", "seq").dropDuplicates(["t", "id"]).select("t", "seq")
    seqs = cut(seqs, "sequences")
    label: DataFrame | None = None
    near = F.least("size", "other") >= F.lit(least) * F.greatest("size", "other")
    pairs = buckets.where((F.col("t") != F.col("leader")) & near).select(F.least("t", "leader").alias("t"), F.greatest("t", "leader").alias("leader")).distinct()
    pairs = cut(pairs, "pairs")
    links = cut(verify(pairs, seqs, least), "links")
    if not links.isEmpty():
        label = components(links.select(F.col("t").alias("a"), F.col("leader").alias("b")))
    # Buckets of one class have nothing left to say, nor have those of two texts, which have met.
    now = buckets.select("key", "t")
    now = now.join(label.withColumnRenamed("v", "t"), "t", "left").select("key", "t", F.coalesce("c", "t").alias("c")) if label is not None else now.withColumn("c", F.col("t"))
    open_ = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo != hi AND n > 2").select("key")
    left = cut(salted(now, open_, "key", heavy_keys, F.xxhash64("t")).select("t", "c").distinct(), "open")
    if not left.isEmpty():
        whole = cut(left.join(seqs, "t").select("t", "c", "seq"), "open_sequences")
        new = cross_pairs(whole, left.count(), least).join(pairs, ["t", "leader"], "left_anti")  # what has met isn't compared again
        links = cut(verify(cut(new, "pairs"), seqs, least), "links")
        if not links.isEmpty():
            if label is None:
                label = components(links.select(F.col("t").alias("a"), F.col("leader").alias("b")))
            else:
                # Links between classes, by their labels; members then take their label's new label.
                old = label
                ends = links.join(old.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t", "left").join(old.select(F.col("v").alias("leader"), F.col("c").alias("cl")), "leader", "left")
                new = components(ends.select(F.coalesce("ct", "t").alias("a"), F.coalesce("cl", "leader").alias("b")))
                moved = new.select(F.col("v").alias("c"), F.col("c").alias("to"))
                h = hot_keys(old.groupBy("c").agg(F.count("*").alias("n")), "c", "n")
                kept = salted(old, moved, "c", h, F.xxhash64("v"), "left").select("v", F.coalesce("to", "c").alias("c"))
                label = cut(kept.union(new.join(old.select("v"), "v", "left_anti")), "labels")
    final = texts.select("t", "doc", "n")
    if label is None:
        final = final.select("t", "n", F.col("doc").alias("class_id"))
    else:
        member = cut(final.join(label.withColumnRenamed("v", "t"), "t").select("t", "doc", "c"), "members")
        h = hot_keys(member.groupBy("c").agg(F.count("*").alias("n")), "c", "n")
        member = salted(member, member.groupBy("c").agg(F.min("doc").alias("class_id")), "c", h, F.xxhash64("t"))
        final = final.join(member.select("t", F.col("class_id").alias("of"), F.lit(True).alias("linked")), "t", "left").select("t", "n", F.when(F.col("linked"), F.col("of")).otherwise(F.col("doc")).alias("class_id"))
    final = cut(final, "classes")
    heavy = hot_keys(final, "t", "n")
    return salted(sk.select("doc_id", "t"), final.select("t", "class_id"), "t", heavy, F.xxhash64("doc_id")).select("doc_id", "t", "class_id")


def first_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that come first in their class: one for each class, that with the least doc_id.

    All columns are kept, whatever their names. Of rows with equal id and text one stays. Texts are shuffled once, by id
    and text, so that no group of copies meets in one task.
    """
    found = cut(classes(docs, least), "found")
    # (id, text) is what tells rows apart; nulls go last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    keep = found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("t")).alias("u")).agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.t").alias("_key"))
    keep = cut(keep, "kept")
    named = docs.select(F.struct("*").alias("r"), F.col("doc_id"), text_key(F.col("text")).alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_key"))
    if not found.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        # Rows that repeat an id and a text: the first of each, chosen before they meet in a shuffle.
        named = named.groupBy("doc_id", "t").agg(F.first("r").alias("r"))
    return named.join(keep, same, "left_semi").select("r.*")
