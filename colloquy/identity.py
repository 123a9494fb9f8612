"""Who a voice is, from who was invited to the meetings in which it was heard.

Voices and attendees are the two sides of a graph whose edges are meetings. First what must be so: a meeting with one unknown voice and one
unknown attendee settles both, which may settle another meeting, until nothing moves. Then what is likely: attendees by the share of a
voice's meetings that they were invited to, taken from the best on, each voice and each attendee once. Both are loops over
DataFrames, of as many rounds as decisions wait for each other; no round holds a library.

Relations: recordings' links to meetings, utterances, attendees (meeting_id, name, email); see :mod:`colloquy.domain`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

# Least coverage, shared meetings and specificity of a strong guess, least coverage of a likely one, and how near to the
# rank of a guess another attendee's makes it doubtful.
STRONG, LIKELY, NEAR = (0.7, 2, 0.5), 0.4, 0.85
TIERS = ("weak", "likely", "strong", "forced")


def attendee_key(name: Column, email: Column) -> Column:
    """An attendee's address in lower case, else the name; null without either."""
    some = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(some(email), some(name))


def read_attendees(meetings: DataFrame) -> DataFrame:
    """meeting_id, name, email from ``meetings`` (id, attendees: JSON, a list of {name, email} or of names); what is neither has none."""
    people = F.from_json("attendees", "array<struct<name: string, email: string>>")
    names = F.from_json("attendees", "array<string>")
    plain = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("email")))
    objects = F.coalesce(F.regexp_like("attendees", F.lit(r"^\s*\[\s*\{")), F.lit(False))
    return meetings.select(F.col("id").alias("meeting_id"), F.explode(F.when(objects, people).otherwise(plain)).alias("a")).select("meeting_id", F.coalesce("a.name", F.lit("")).alias("name"), "a.email")


def contexts(links: DataFrame, utterances: DataFrame, attendees: DataFrame, personas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(meeting_id, w, voice) and (meeting_id, w, person, name, email), each pair once, of meetings in whose recordings somebody speaks.

    ``links``: recording_id, meeting_id, link_type, is_dismissed. ``personas`` (speaker_uuid, persona): voices that are one are taken
    for one.
    """
    heard = utterances.where("speaker_uuid IS NOT NULL").select("recording_id", "speaker_uuid").distinct()
    if personas is not None:
        heard = heard.join(personas, "speaker_uuid", "left").select("recording_id", F.coalesce("persona", "speaker_uuid").alias("speaker_uuid")).distinct()
    open_ = links.where("NOT is_dismissed").select("recording_id", "meeting_id", F.when(F.col("link_type") == "matched", 2).when(F.col("link_type") == "suggested", 1).otherwise(0).alias("rank"))
    met = open_.join(heard, "recording_id")
    weight = met.groupBy("meeting_id").agg(F.max("rank").alias("r")).select("meeting_id", F.when(F.col("r") == 2, 1.0).when(F.col("r") == 1, 0.6).otherwise(0.3).alias("w"))
    voices = met.select("meeting_id", F.col("speaker_uuid").alias("voice")).distinct().join(weight, "meeting_id")
    people = attendees.withColumn("person", attendee_key(F.col("name"), F.col("email"))).where("person IS NOT NULL")
    people = people.groupBy("meeting_id", "person").agg(F.min_by(F.struct("name", "email"), F.struct("name", F.coalesce("email", F.lit("")))).alias("a")).select("meeting_id", "person", "a.*").join(weight, "meeting_id")
    return voices.select("meeting_id", "w", "voice"), people.select("meeting_id", "w", "person", "name", "email")


def deduced(voices: DataFrame, people: DataFrame, known: DataFrame) -> DataFrame:
    """voice, person, meeting_id, size: what meetings with one unknown of each kind settle. ``known`` (voice, person; either may be null) is
    settled before: the owner, and what a person has typed in.

    Of deductions of one round that contradict each other, that of the later meeting (the greater meeting_id) counts; the others are looked at
    again.
    """
    spark = voices.sparkSession
    settled = cut(known.select("voice", "person").distinct(), "known")
    size = people.groupBy("meeting_id").agg(F.count("*").alias("size"))
    found = spark.createDataFrame([], "voice string, person string, meeting_id long, size long")
    v, p = voices.select("meeting_id", "voice"), people.select("meeting_id", "person")
    while True:
        v = cut(v.join(settled.where("voice IS NOT NULL").select("voice").distinct(), "voice", "left_anti"), "voices")
        p = cut(p.join(settled.where("person IS NOT NULL").select("person").distinct(), "person", "left_anti"), "people")
        one_v = v.groupBy("meeting_id").agg(F.count("*").alias("n"), F.min("voice").alias("voice")).where("n = 1")
        one_p = p.groupBy("meeting_id").agg(F.count("*").alias("n"), F.min("person").alias("person")).where("n = 1")
        said = one_v.select("meeting_id", "voice").join(one_p.select("meeting_id", "person"), "meeting_id").groupBy("voice", "person").agg(F.max("meeting_id").alias("meeting_id"))
        first = lambda by: F.max("meeting_id").over(Window.partitionBy(by)) == F.col("meeting_id")
        new = cut(said.where(F.col("meeting_id").isNotNull()).select("*", first("voice").alias("a"), first("person").alias("b")).where("a AND b").select("voice", "person", "meeting_id"), "deduced")
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new.join(size, "meeting_id").select("voice", "person", "meeting_id", "size")), "found")
        settled = new.select("voice", "person")


def candidates(voices: DataFrame, people: DataFrame) -> DataFrame:
    """voice, person, coverage, specificity, shared, total, rank of each voice and attendee who share a meeting."""
    vw = voices.groupBy("voice").agg(F.sum("w").alias("vw"), F.count("*").alias("total"))
    aw = people.groupBy("person").agg(F.sum("w").alias("aw"))
    both = voices.join(people.select("meeting_id", "person"), "meeting_id").groupBy("voice", "person").agg(F.sum("w").alias("w"), F.count("*").alias("shared"))
    both = both.join(vw, "voice").join(aw, "person").withColumns({"coverage": F.col("w") / F.col("vw"), "specificity": F.col("w") / F.col("aw")})
    return both.select("voice", "person", "coverage", "specificity", "shared", "total", (F.col("coverage") * F.col("shared")).alias("rank"))


def _order() -> list[Column]:
    """Better first: a total order."""
    return [F.desc("rank"), F.desc("specificity"), F.desc("shared"), F.asc("voice"), F.asc("person")]


def matched(scored: DataFrame) -> DataFrame:
    """Of ``scored`` (:func:`candidates`) each voice and each person once, the best first, as if taken one by one.

    A candidate that is the best of both its voice and its person is taken in any case, so a round takes all of these.
    """
    left = cut(scored, "scored")
    taken = left.limit(0)
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*_order())) == 1
    while True:
        new = cut(left.select("*", best("voice").alias("a"), best("person").alias("b")).where("a AND b").drop("a", "b"), "taken")
        if new.isEmpty():
            return taken
        taken = cut(taken.unionByName(new), "matched")
        left = cut(left.join(new.select("voice"), "voice", "left_anti").join(new.select("person"), "person", "left_anti"), "left")


def tiered(taken: DataFrame, scored: DataFrame) -> DataFrame:
    """``taken`` with tier and rival: strong, likely or weak by coverage; strong becomes likely, and the rival is named, if another
    attendee of the voice has nearly the same rank."""
    place = F.row_number().over(Window.partitionBy("voice").orderBy(*_order()))
    two = scored.withColumn("place", place).where("place <= 2").select("voice", F.col("person").alias("other"), F.col("rank").alias("other_rank"), "place")
    rival = taken.select("voice", "person").join(two, "voice").where("other <> person").groupBy("voice").agg(F.min_by(F.struct("other", "other_rank"), "place").alias("r"))
    out = taken.join(rival, "voice", "left").withColumn("rival", F.when(F.col("r.other_rank") >= F.col("rank") * NEAR, F.col("r.other")))
    strong = (F.col("coverage") >= STRONG[0]) & (F.col("shared") >= STRONG[1]) & (F.col("specificity") >= STRONG[2])
    tier = F.when(strong & F.col("rival").isNull(), "strong").when(strong | (F.col("coverage") >= LIKELY), "likely").otherwise("weak")
    return out.withColumn("tier", tier).drop("r")


def infer(links: DataFrame, utterances: DataFrame, attendees: DataFrame, known: DataFrame, personas: DataFrame | None = None, least: str = "weak", rejected: DataFrame | None = None) -> DataFrame:
    """speaker_uuid, person, name, email, tier, score, reason: who each voice may be, from tier ``least`` on.

    ``known`` (voice, person): the owner's voice and address and what people have mapped; either side may be null. ``personas``
    (speaker_uuid, persona): voices that are one are pooled before, and each has the answer of its persona. Voices in ``rejected``
    (speaker_uuid) have none.
    """
    if personas is not None:
        known = known.join(personas.withColumnRenamed("speaker_uuid", "voice"), "voice", "left").select(F.coalesce("persona", "voice").alias("voice"), "person")
    voices, people = (cut(x, n) for x, n in zip(contexts(links, utterances, attendees, personas), ("voices", "people"), strict=True))
    forced = cut(deduced(voices, people, known), "forced")
    settled = known.select("voice", "person").unionByName(forced.select("voice", "person"))
    free_v = settled.where("voice IS NOT NULL").select("voice").distinct()
    free_p = settled.where("person IS NOT NULL").select("person").distinct()
    scored = cut(candidates(voices, people).join(free_v, "voice", "left_anti").join(free_p, "person", "left_anti"), "scored")
    guessed = tiered(matched(scored), scored)
    shown = people.groupBy("person").agg(F.max_by(F.struct("name", "email"), "meeting_id").alias("a")).select("person", F.coalesce(F.nullif(F.trim("a.name"), F.lit("")), F.trim("a.email")).alias("name"), "a.email")
    one = F.when(F.col("size") == 2, F.concat(F.lit("Only unidentified person in your 1:1 with "), "name")).otherwise(F.concat(F.lit("Only unidentified person in a "), F.col("size").cast("string"), F.lit("-person meeting")))
    sure = forced.join(shown, "person").select("voice", "person", "name", "email", F.lit("forced").alias("tier"), F.lit(1.0).alias("score"), one.alias("reason"))
    other = shown.select(F.col("person").alias("rival"), F.col("name").alias("rival_name"))
    often = F.concat(F.lit("In "), F.col("shared").cast("string"), F.lit(" of this voice's "), F.col("total").cast("string"), F.when(F.col("total") == 1, " meeting").otherwise(" meetings"), F.coalesce(F.concat(F.lit(" — could also be "), "rival_name"), F.lit("")))
    likely = guessed.join(shown, "person").join(other, "rival", "left").select("voice", "person", "name", "email", "tier", F.col("coverage").alias("score"), often.alias("reason"))
    out = sure.unionByName(likely).where(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) >= TIERS.index(least) + 1)
    out = out.withColumnRenamed("voice", "speaker_uuid")
    if personas is not None:
        of = personas.select(F.col("persona").alias("speaker_uuid"), F.col("speaker_uuid").alias("member"))
        out = out.join(of, "speaker_uuid", "left").withColumn("speaker_uuid", F.coalesce("member", "speaker_uuid")).drop("member")
    return out if rejected is None else out.join(rejected, "speaker_uuid", "left_anti")
