"""Token counts: pieces are counted once for each distinct pre-token, and documents sum over their frequencies.

No ids are made for a document. :func:`count_by_join` is that plan over the corpus: distinct pre-tokens are counted by
the library, joined to the pre-token frequencies of documents, and summed. Its rows of documents and pre-tokens are
several times the corpus where words are many, so :func:`count_tokens` joins within a worker: a batch of documents is
turned into pre-token frequencies, those pre-tokens that the worker hasn't met are counted by the library in one call,
and the table of pieces is the build side of a hash join that is emptied at a fixed size. Both give the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh, hot_keys, salted

#: Pre-tokens that a worker keeps: about 60 MB. Beyond, the table starts anew; results don't depend on it.
KEEP = 400_000
#: White space that splits a text into pre-tokens. Only characters that the tokenizer itself treats as white space.
BREAKS = "\t\n\x0b\x0c\r"


class PieceCounts:
    """Pieces of each distinct pre-token, by tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known: dict[str, int] = {}

    def count(self, docs: list[Counter]) -> list[int]:
        """The sum of frequency times pieces of each document."""
        known = self.known
        if len(known) > KEEP:
            known.clear()
        new = list({w for d in docs for w in d if w not in known})
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            known.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(int.__mul__, map(known.__getitem__, d), d.values())) for d in docs]


_LOADED: dict[str, PieceCounts] = {}


def pre_tokens(text: str) -> Counter:
    """Frequencies of the stretches between white space: no token of the tokenizers used here crosses it."""
    for c in BREAKS:
        text = text.replace(c, " ")
    freq = Counter(text.split(" "))
    freq.pop("", None)
    return freq


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), one row for each row.

    ``path``: a tokenizers file that drops white space and never joins across it. Special strings inside a text count
    as the library counts them. Null and empty texts have no bytes and no tokens. Whole texts are counted; repeated rows
    are counted each; other columns are ignored.
    """
    text = fresh(["doc_id"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = PieceCounts(path)
        counts = _LOADED[path]
        for batch in batches:
            got: list[int] = []
            for i in range(0, batch.num_rows, 500):
                got += counts.count([pre_tokens(x or "") for x in batch.column(2).slice(i, 500).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    few = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias(text))
    kind = few.schema["doc_id"].dataType.simpleString()
    out = few.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def count_by_join(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """The rows of :func:`count_tokens`, with each distinct pre-token of the corpus counted once.

    Shuffles a row for each document and distinct pre-token in it, twice (by pre-token, by document).
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                f = [pre_tokens(x or "") for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x) for x in f], pa.list_(pa.string())), pa.array([list(x.values()) for x in f], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "words", "times"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                w = batch.column(0).slice(i, 5000)
                yield pa.RecordBatch.from_arrays([w, pa.array(list(map(len, counts.tok.encode_batch_fast(w.to_pylist(), add_special_tokens=False))), pa.int64())], ["w", "pieces"])

    few = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias(fresh(["doc_id"], "text")))
    # Rows have numbers once they are written: ids may be null or repeated.
    made = few.mapInArrow(frequencies, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, words array<string>, times array<bigint>")
    rows = cut(made.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    pairs = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("w"), F.col("p.times").alias("times"))
    kinds = cut(pairs.groupBy("w").agg(F.count("*").alias("n")), "pre_tokens")
    known = cut(kinds.select("w").mapInArrow(pieces, "w string, pieces bigint"), "pieces")
    sums = salted(pairs, known, "w", hot_keys(kinds, "w", "n"), F.xxhash64("row")).groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_tokens"))
    out = rows.select("row", "doc_id", "n_bytes").join(sums, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
