"""A stored inverted index: postings that a search of a few words reads by those words alone.

Two tables in versions (:mod:`colloquy.versions`), and statistics beside them:

* ``postings``, in buckets by term: term, field, doc, its recording, place, speaker and length, and the places of the term in it. Files
  are in order of term, so of a bucket only the row groups of a term are read.
* ``docs``, in buckets by document: what is indexed of it, with its version and its different terms. It tells an update
  which postings go.
* facts: documents and terms of each field, the numbers of buckets, the batches that have been taken in.

An update writes what changed as a further folder of the buckets that it touches: new postings, and marks without places for terms
that a document no longer has. Readers keep the latest entry of each (term, document). :meth:`KeywordIndex.compact` makes
one folder of many. Scores need how many documents have a term: that is counted from the term's own postings, after changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import SPARK
from .storage import cut
from .versions import Versions, bucket_of, whole, with_folder

#: Letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
#: Terms (with repeats) and documents of a bucket, about; and how many buckets there are at least and at most.
TERMS_A_BUCKET, DOCS_A_BUCKET, LEAST, MOST = 4_000_000, 500_000, 8, 65_536
#: Folders of a bucket from which on compaction takes it.
FOLDERS = 8

CHANGES = "field string, doc long, version long, visible boolean, recording_id long, place_in long, speaker_uuid string, text string"
KEPT = ("field", "doc", "recording_id", "place_in", "speaker_uuid", "len")


def tokenised(docs: DataFrame) -> DataFrame:
    """``docs`` (CHANGES) with ``ws``, the terms of the visible ones in order, in the place of the text."""
    words = F.expr(SPARK.find(SPARK.fold("text"), TOKEN))
    out = docs.withColumn("ws", F.when(F.col("visible"), F.coalesce(words, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).drop("text")
    return out.select("field", F.col("doc").cast("long"), F.col("version").cast("long"), "visible", F.col("recording_id").cast("long"), F.col("place_in").cast("long"), "speaker_uuid", "ws", F.size("ws").cast("long").alias("len"))


def postings(docs: DataFrame, buckets: int, stamp: int) -> DataFrame:
    """bucket, term, KEPT, stamp, places: a row for each different term of each of ``docs`` (:func:`tokenised`)."""
    each = docs.select(*KEPT, F.posexplode("ws").alias("place", "term"))
    found = each.groupBy("term", *KEPT).agg(F.array_sort(F.collect_list("place")).alias("places"))
    return found.select(bucket_of(["term"], buckets).alias("bucket"), "term", *KEPT, F.lit(stamp).cast("long").alias("stamp"), "places")


def forward(docs: DataFrame, buckets: int, stamp: int) -> DataFrame:
    return docs.select(bucket_of(["field", "doc"], buckets).alias("bucket"), *KEPT, "version", "visible", F.array_distinct("ws").alias("terms"), F.lit(stamp).cast("long").alias("stamp"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row with the greatest stamp."""
    rest = F.struct("stamp", *[c for c in rows.columns if c not in (*keys, "stamp")])
    return rows.groupBy(*keys).agg(F.max_by(rest, "stamp").alias("r")).select(*keys, "r.*")


class KeywordIndex:
    """The index at a path, as of its latest version, or of one that is named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Versions(spark, path)

    # --- writing

    @classmethod
    def build(cls, spark: SparkSession, path: str, docs: DataFrame) -> KeywordIndex:
        """A new version of nothing but ``docs`` (CHANGES; one row for each field and doc)."""
        self = cls(spark, path)
        base = self.log.manifest()
        told = cut(tokenised(docs), "tokens")
        sums = {r["field"]: {"n": r["n"], "terms": r["terms"] or 0} for r in told.where("visible").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("terms")).collect()}  # a row for each field
        dealt = lambda n, each: max(LEAST, min(MOST, -(-n // each)))
        by = {"postings": dealt(sum(s["terms"] for s in sums.values()), TERMS_A_BUCKET), "docs": dealt(sum(s["n"] for s in sums.values()), DOCS_A_BUCKET)}
        stamp = base["version"] + 1
        # Ranges split a term that very many documents have; a hash wouldn't.
        words = postings(told, by["postings"], stamp).repartitionByRange("bucket", "term", "field", "doc").sortWithinPartitions("bucket", "term", "field", "doc")
        rows = forward(told, by["docs"], stamp).repartitionByRange("bucket", "field", "doc").sortWithinPartitions("bucket", "field", "doc")
        tables = {"postings": whole(words, *self.log.stage(words)), "docs": whole(rows, *self.log.stage(rows))}
        self.log.commit(base, tables, {"buckets": by, "fields": sums, "batches": {}})
        return self

    def apply(self, changes: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Take ``changes`` (CHANGES) in: the new version. Of a document the greatest ``version`` counts, whether it is stored or comes
        now; what isn't visible is kept as a mark of its version. A batch of a stream that was taken in before changes nothing."""
        base = self.log.manifest()
        if not base["version"]:
            raise ValueError("there is no index yet")
        facts = base["facts"]
        if stream is not None and facts["batches"].get(stream, -1) >= batch:
            return base["version"]
        by, stamp = facts["buckets"], base["version"] + 1
        rest = F.struct(*[c for c in changes.columns if c not in ("field", "doc")])
        latest = changes.groupBy("field", "doc").agg(F.max_by(rest, "version").alias("r")).select("field", "doc", "r.*")
        new = cut(tokenised(latest).withColumn("bucket", bucket_of(["field", "doc"], by["docs"])), "changes")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # numbers of buckets
        old = newest(self.log.read(base, "docs", touched), ["field", "doc"]).select("field", "doc", F.col("version").alias("old_version"), F.when(F.col("visible"), F.col("len")).alias("old_len"), F.col("terms").alias("old_terms"), *[F.col(c).alias(f"old_{c}") for c in ("recording_id", "place_in", "speaker_uuid")])
        both = cut(new.join(old, ["field", "doc"], "left").where(F.col("old_version").isNull() | (F.col("version") > F.col("old_version"))), "changed")
        gone = both.select(F.explode(F.array_except(F.coalesce("old_terms", F.array().cast("array<string>")), "ws")).alias("term"), *KEPT)
        marks = gone.select(bucket_of(["term"], by["postings"]).alias("bucket"), "term", *KEPT, F.lit(stamp).cast("long").alias("stamp"), F.lit(None).cast("array<int>").alias("places"))
        words = postings(both.select(*KEPT, "ws"), by["postings"], stamp).unionByName(marks).repartition("bucket").sortWithinPartitions("bucket", "term", "field", "doc")
        rows = forward(both, by["docs"], stamp).repartition("bucket").sortWithinPartitions("bucket", "field", "doc")
        fields = {k: dict(v) for k, v in facts["fields"].items()}
        seen = F.col("visible").cast("long")
        for r in both.groupBy("field").agg(F.sum(seen - F.col("old_len").isNotNull().cast("long")).alias("n"), F.sum(seen * F.col("len") - F.coalesce("old_len", F.lit(0))).alias("terms")).collect():  # a row for each field
            of = fields.setdefault(r["field"], {"n": 0, "terms": 0})
            of["n"], of["terms"] = of["n"] + r["n"], of["terms"] + r["terms"]
        tables = {name: with_folder(base["tables"][name], *self.log.stage(df), instead=False) for name, df in (("postings", words), ("docs", rows))}
        batches = facts["batches"] if stream is None else facts["batches"] | {stream: batch}
        return self.log.commit(base, tables, facts | {"fields": fields, "batches": batches})["version"]

    def follow(self, changes: DataFrame, checkpoint: str, name: str = "changes"):
        """Keep the index up with a stream of changes until the stream has no more; each batch is one version, taken in once."""
        return changes.writeStream.foreachBatch(lambda batch, n: self.apply(batch, name, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact(self, folders: int = FOLDERS) -> int:
        """A version in which buckets of at least ``folders`` folders have one, without marks. Readers see no difference."""
        base = self.log.manifest()
        tables, done = dict(base["tables"]), False
        for name, keys in (("postings", ["term", "field", "doc"]), ("docs", ["field", "doc"])):
            many = [int(b) for b, f in base["tables"].get(name, {"parts": {}})["parts"].items() if len(f) >= folders]
            if not many:
                continue
            rows, n = newest(self.log.read(base, name, many), keys), base["facts"]["buckets"][name]
            rows = rows.where("places IS NOT NULL") if name == "postings" else rows
            rows = rows.withColumn("bucket", bucket_of(keys[:1] if name == "postings" else keys, n))
            staged, written = self.log.stage(rows.select("bucket", *[f["name"] for f in base["tables"][name]["schema"]["fields"]]).repartitionByRange("bucket", *keys).sortWithinPartitions("bucket", *keys))
            tables[name] = with_folder(base["tables"][name], staged, written, instead=True)
            tables[name]["parts"] = {b: f for b, f in tables[name]["parts"].items() if int(b) not in many or int(b) in written}
            done = True
        return self.log.commit(base, tables, base["facts"])["version"] if done else base["version"]

    # --- reading

    def buckets(self, terms: list[str], manifest: dict) -> list[int]:
        """The buckets of some terms."""
        n = manifest["facts"]["buckets"]["postings"]
        rows = self.spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").select(bucket_of(["term"], n).alias("b")).collect()
        return sorted({r["b"] for r in rows})

    def postings(self, terms: list[str], version: int | None = None) -> DataFrame:
        """term, KEPT, places: the postings of some terms. Only the folders of their buckets are opened."""
        manifest = self.log.manifest(version)
        asked = self.buckets(terms, manifest)
        rows = self.log.read(manifest, "postings", asked).where(F.col("term").isin(list(dict.fromkeys(terms))))
        parts = manifest["tables"]["postings"]["parts"]
        if any(len(parts.get(str(b), [])) > 1 for b in asked):
            rows = newest(rows, ["term", "field", "doc"])
        return rows.where("places IS NOT NULL").select("term", *KEPT, "places")

    def corpus(self, version: int | None = None) -> DataFrame:
        """field, n, mean: how many documents each field has, and their mean length."""
        fields = self.log.manifest(version)["facts"]["fields"]
        rows = [(k, int(v["n"]), v["terms"] / v["n"]) for k, v in fields.items() if v["n"]]
        return self.spark.createDataFrame(rows, "field string, n long, mean double")

    def vocabulary(self, version: int | None = None) -> DataFrame:
        """term, df, tf, first_place over one field's postings, of all terms: a scan of the index."""
        rows = newest(self.log.read(self.log.manifest(version), "postings"), ["term", "field", "doc"]).where("places IS NOT NULL")
        return rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum(F.size("places")).alias("tf"), F.min(F.element_at("places", 1)).cast("long").alias("first_place"))
