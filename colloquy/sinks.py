"""What is written: exports, a recording's lines replaced as a whole, versions of assignments that can be undone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import exists

EXPORTS = ("csv", "json", "txt", "parquet")


def export(recordings: DataFrame, path: str, kind: str) -> None:
    """Recordings (file_name, created_at, duration, language, status, error, transcript) as files of a kind, at ``path``.

    csv: with a header, all fields quoted, quotes doubled, line breaks in the transcript as spaces. txt: a block for each
    recording. Executors write; nothing comes to the driver.
    """
    if kind == "csv":
        named = {"file_name": "File Name", "created_at": "Date", "duration": "Duration", "language": "Language", "status": "Status", "error": "Error", "transcript": "Transcript"}
        out = recordings.withColumn("transcript", F.regexp_replace("transcript", "\n", " ")).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in named.items()])
        out.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "json":
        recordings.write.json(path)
    elif kind == "parquet":
        recordings.write.parquet(path)
    elif kind == "txt":
        line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
        rest = F.when(F.coalesce(F.col("transcript"), F.lit("")) == "", "[No transcript available]").otherwise(F.col("transcript"))
        error = F.when(F.col("error").isNotNull(), line("Error", "error"))
        block = F.concat_ws("\n", line("File", "file_name"), line("Date", "created_at"), line("Duration", "duration"), line("Language", "language"), line("Status", "status"), error, F.lit("\nTranscript:"), rest, F.lit("\n" + "-" * 50 + "\n"))
        recordings.select(block.alias("value")).write.text(path)
    else:
        raise ValueError(f"no such kind of export: {kind}; one of {', '.join(EXPORTS)}")


def replace_recordings(lines: DataFrame, path: str) -> None:
    """Put ``lines`` in the place of all lines of their recordings in the table at ``path`` (partitioned by recording_id).

    The new lines are written beside the table first and checked by reading them; only then are their partitions
    overwritten. If anything fails before, the table is as it was.
    """
    spark = lines.sparkSession
    staging = f"{path}-staging-{uuid.uuid4().hex}"
    lines.write.parquet(staging)
    spark.read.schema(lines.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: str, version: int) -> DataFrame:
    """The next version of a table: ``rows`` in the place of those with the same keys, the latest by ``order`` of each. The
    version before stays. Returns the new version."""
    old = spark.read.parquet(f"{path}/version={version - 1}") if exists(spark, f"{path}/version={version - 1}") else rows.limit(0)
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    both = old.unionByName(rows).groupBy(*keys).agg(F.max_by(rest, order).alias("r")).select(*keys, "r.*")
    both.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


class Assignments:
    """Who a voice is (id, speaker_uuid), in versions: each change keeps what it changed, so that it can be undone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def start(self, rows: DataFrame) -> None:
        rows.select("id", "speaker_uuid").write.mode("overwrite").parquet(f"{self.path}/now=0")

    def now(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/now={version}")

    def apply(self, version: int, changes: DataFrame) -> DataFrame:
        """Version + 1: ``changes`` (id, speaker_uuid) applied. What they change is kept as the snapshot of that version."""
        old = self.now(version)
        new = changes.select("id", F.col("speaker_uuid").alias("to"))
        old.join(new, "id").where(~F.col("speaker_uuid").eqNullSafe(F.col("to"))).write.mode("overwrite").parquet(f"{self.path}/before={version + 1}")
        out = old.join(new.withColumn("given", F.lit(True)), "id", "left").select("id", F.when(F.col("given"), F.col("to")).otherwise(F.col("speaker_uuid")).alias("speaker_uuid"))
        out.write.mode("overwrite").parquet(f"{self.path}/now={version + 1}")
        return self.now(version + 1)

    def undo(self, version: int, at: int) -> DataFrame:
        """Version + 1: the change that made version ``at`` taken back, for rows that nobody has changed since."""
        before = self.spark.read.parquet(f"{self.path}/before={at}").select("id", F.col("speaker_uuid").alias("was"), "to")
        out = self.now(version).join(before.withColumn("changed", F.lit(True)), "id", "left")
        same = F.coalesce(F.col("changed"), F.lit(False)) & F.col("speaker_uuid").eqNullSafe(F.col("to"))
        out.select("id", F.when(same, F.col("was")).otherwise(F.col("speaker_uuid")).alias("speaker_uuid")).write.mode("overwrite").parquet(f"{self.path}/now={version + 1}")
        return self.now(version + 1)
