"""Readers of recogniser output: token sidecars, diarised JSON in several spellings, truncated JSON; and a watched folder."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TOKENS = "struct<transcription:array<struct<offsets:struct<from:bigint,to:bigint>,text:string,tokens:array<struct<text:string,id:bigint,p:double>>>>>"


def tokens(raw: DataFrame, column: str = "json") -> DataFrame:
    """Token sidecars -> recording_id, start_time, end_time, text, n, mean_p. Broken JSON and reversed spans give no rows."""
    parsed = raw.select("recording_id", F.explode(F.from_json(column, TOKENS)["transcription"]).alias("s"))
    spoken = F.filter("s.tokens", lambda t: ~F.startswith(t["text"], F.lit("[_")))
    out = parsed.select(
        "recording_id", (F.col("s.offsets.from") / 1000).alias("start_time"), (F.col("s.offsets.to") / 1000).alias("end_time"), F.trim("s.text").alias("text"), F.size(spoken).alias("n"),
        F.when(F.size(spoken) > 0, F.aggregate(spoken, F.lit(0.0), lambda a, t: a + t["p"]) / F.size(spoken)).alias("mean_p"),
    )
    return out.where("end_time >= start_time")


def seconds(text: Column) -> Column:
    """12.5, 12.5s, mm:ss and hh:mm:ss as seconds; anything else, true and false among it, is null."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(text)), "s$", ""))
    clock = F.aggregate(F.split(t, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double"))
    return F.when(t.rlike(r"^[-+]?[0-9]+([.][0-9]*)?(e[-+]?[0-9]+)?$"), t.cast("double")).when(t.rlike(r"^[0-9]+(:[0-9]+([.][0-9]+)?){1,2}$"), clock)


FENCE = r"(?s)^\s*```[^\n]*\n|\n?```\s*$"
#: The newest envelope that is understood.
SCHEMA_VERSION = 1


def diarised(raw: DataFrame, column: str = "json", duration: str | None = None, offset: float = 0.0) -> DataFrame:
    """Whole recogniser output, an envelope with segments or a list of them -> recording_id, start_time, end_time, speaker,
    text, problem.

    Code fences are dropped, keys may have a capital, times are held within 0 and ``duration`` (a column) and moved by
    ``offset``. Blank text and spans without length are dropped. Output that isn't whole JSON, is newer than is understood
    or has no segment left gives one row that only says so.
    """
    rows = "array<map<string,string>>"  # maps tell "start" from "Start"
    text = F.regexp_replace(F.trim(column), FENCE, "")
    r = raw.select("recording_id", *([] if duration is None else [duration]), text.alias("_t"))
    env = F.from_json("_t", f"struct<schema_version:int,segments:{rows}>", {"mode": "PERMISSIVE"})
    r = r.withColumn("_e", env).withColumn("_s", F.when(F.col("_t").rlike(r"(?s)^\s*\["), F.from_json("_t", rows)).otherwise(F.col("_e.segments")))
    late = F.coalesce(F.col("_e.schema_version"), F.lit(0)) > SCHEMA_VERSION
    last = F.lit(None).cast("double") if duration is None else F.when(F.col(duration) > 0, F.col(duration))
    both = lambda x, a, b: F.coalesce(F.try_element_at(x, F.lit(a)), F.try_element_at(x, F.lit(b)))

    def segment(x: Column) -> Column:
        start, end = F.greatest(both(x, "start", "Start").try_cast("double"), F.lit(0.0)), F.least(both(x, "end", "End").try_cast("double"), last)
        return F.struct((start + offset).alias("start_time"), (end + offset).alias("end_time"), F.concat(F.lit("Speaker "), both(x, "speaker", "Speaker")).alias("speaker"), F.trim(both(x, "text", "Content")).alias("text"))

    good = F.filter(F.transform(F.when(~late, F.col("_s")), segment), lambda x: (x["text"] != "") & (x["end_time"] > x["start_time"]))
    r = r.withColumn("_g", good)
    problem = F.when(late, "newer than is understood").when(F.col("_s").isNull(), "not whole").when(F.coalesce(F.size("_g"), F.lit(0)) < 1, "no segments")
    return r.select("recording_id", problem.alias("problem"), F.explode_outer(F.when(problem.isNull(), F.col("_g"))).alias("g")).select("recording_id", "g.*", "problem")


@F.pandas_udf(ArrayType(StringType()))
def complete_objects(text: pd.Series) -> pd.Series:
    """Every complete JSON object of a text that may break off, in order; braces inside strings and objects are theirs."""
    decoder = json.JSONDecoder()

    def scan(t: str | None) -> list[str]:
        out, at = [], 0
        while t and (at := t.find("{", at)) >= 0:
            try:
                found, end = decoder.raw_decode(t, at)
            except ValueError:
                at += 1
                continue
            for x in found.get("segments", [found]) if isinstance(found.get("segments", [found]), list) else [found]:
                out.append(json.dumps(x, ensure_ascii=False))
            at = end
        return out

    return text.map(scan)


START_KEYS = ("start_time", "start", "Start", "Start time", "start time", "startTime")
END_KEYS = ("end_time", "end", "End", "End time", "end time", "endTime")
SPEAKER_KEYS = ("speaker_id", "speaker", "Speaker", "Speaker ID", "speaker id", "speakerId")


def segments(raw: DataFrame, column: str = "json") -> DataFrame:
    """Recogniser output that may break off -> recording_id, start_time, end_time, speaker, text.

    Every complete object counts, so that a truncated array keeps what it has; keys come in several spellings, times as
    numbers, with an s, or as clocks. Objects without times, with blank text or without length are dropped.
    """
    o = raw.select("recording_id", F.explode(complete_objects(F.col(column))).alias("o")).select("recording_id", F.from_json("o", "map<string,string>").alias("o"))
    first = lambda names: F.coalesce(*[F.try_element_at("o", F.lit(n)) for n in names])
    out = o.select("recording_id", seconds(first(START_KEYS)).alias("start_time"), seconds(first(END_KEYS)).alias("end_time"), F.coalesce(first(SPEAKER_KEYS), F.lit("unknown")).alias("speaker"), F.trim(first(("text", "content", "Content"))).alias("text"))
    return out.where("text <> '' AND end_time > start_time")


def watched(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """New files of a folder as a stream; the checkpoint of the query that reads it is the ledger of what has been seen."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("latestFirst", "false").json(folder)


def collect(stream: DataFrame, table: str, ledger: str) -> None:
    """Add a stream of new files to the table at ``table``, once: a batch's rows are a partition that is written whole, so
    a batch that is run again replaces itself. ``ledger``: the stream's checkpoint."""

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", ledger).trigger(availableNow=True).start().awaitTermination()
