"""The library's reads and writes as methods that take and return DataFrames.

A library is a folder of the driver's tables or a deployment's own relations by name (see :mod:`colloquy.domain`). Lanes of
the search are functions, so a deployment can plug in its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import SPARK
from .domain import Relations
from .index import KeywordIndex
from .plans import analytics, library, search
from .vectors import VectorIndex

KEYWORD, SEMANTIC, ANN, HYBRID = "keyword", "semantic", "ann", "hybrid"
MOST_LISTED, MOST_FOUND, MOST_QUERY = 100, 50, 2000
candidate_limit = search.candidate_limit


class SearchUnavailable(RuntimeError):
    """The asked mode needs vectors that aren't there."""


class Conflict(RuntimeError):
    """A change was made to another version than the one that is stored."""


def route(mode: str, ready: bool, keyword: Callable[[], DataFrame], semantic: Callable[[], DataFrame], hybrid: Callable[[], DataFrame], fallback: bool = True, ann: Callable[[], DataFrame] | None = None) -> tuple[str, DataFrame, str | None]:
    """(mode that ran, result, note). Hybrid falls back to keyword if vectors aren't ready or fail, where that is allowed."""
    if mode == KEYWORD:
        return KEYWORD, keyword(), None
    if not ready:
        if mode == HYBRID and fallback:
            return KEYWORD, keyword(), "vectors aren't ready"
        raise SearchUnavailable("vectors aren't ready")
    if mode == SEMANTIC:
        return SEMANTIC, semantic(), None
    if mode == ANN:
        return ANN, (ann or semantic)(), None
    if mode != HYBRID:
        raise ValueError(f"no such mode: {mode}")
    try:
        return HYBRID, hybrid(), None
    except SearchUnavailable as e:
        if not fallback:
            raise
        return KEYWORD, keyword(), str(e)


@dataclass(frozen=True)
class Scope:
    """What a search or a list stays within; every filter that is given, all at once (see library.recording_filter)."""

    tags: tuple = ()
    all_tags: bool = False
    speakers: tuple = ()
    sources: tuple = ()
    events: tuple = ()
    has_transcript: bool | None = None
    has_open_comments: bool | None = None
    text: str | None = None
    first: int | None = None
    last: int | None = None

    def condition(self, **more) -> str:
        return library.recording_filter(SPARK, **(self.__dict__ | more))


@dataclass
class Found:
    mode: str
    hits: DataFrame
    note: str | None = None
    complete: bool = True
    lanes: dict = field(default_factory=dict)


class Library:
    """One library. Limits are those of its callers, not of the operators below.

    ``ready``: whether vectors can be searched (by default: whether any visible line has one). ``lanes``: functions of
    (query, limit, recordings, speakers) for "keyword" and of (vector, limit, recordings, speakers) for "semantic", which
    give place, identity, recording_id, utterance_id, in the place of the library's own. ``words``, ``voices``: stored indexes
    over the library's lines, which searches then read in the place of all lines; without them every search scans.
    """

    def __init__(self, spark: SparkSession, source: str | dict[str, DataFrame], ready: bool | None = None, lanes: dict[str, Callable[..., DataFrame]] | None = None, words: KeywordIndex | None = None, voices: VectorIndex | None = None):
        self.spark, self.source, self._ready, self.lanes, self.words, self.voices = spark, source, ready, lanes or {}, words, voices
        self.relations = Relations(spark, source)

    def put(self, name: str, df: DataFrame) -> None:
        """``df`` as the library's relation of that name, from now on."""
        self.relations.put(name, df)

    def sql(self, sql: str) -> DataFrame:
        return self.relations.sql(sql)

    def table(self, name: str) -> DataFrame:
        return self.relations.table(name)

    def _run(self, plan: Callable[..., str], **parameters) -> DataFrame:
        return self.sql(plan(SPARK, **parameters))

    def index(self, path: str) -> None:
        """Build both indexes under ``path`` and search by them from now on."""
        self.words = KeywordIndex.build(self.spark, f"{path}/words", self.sql(search.index_docs(SPARK)))
        self.voices = VectorIndex.build(self.spark, f"{path}/voices", self.sql(f"SELECT utterance_id AS id, embedding, of AS recording_id FROM ({search.eligible(SPARK)}) e"))

    # --- reads

    def status(self) -> DataFrame:
        return self._run(analytics.status)

    def ready(self) -> bool:
        return self._ready if self._ready is not None else not self.sql(f"SELECT 1 FROM {search.INDEXED} v LIMIT 1").isEmpty()

    def recordings(self, limit: int = 20, before: tuple[int, int] | None = None, scope: Scope = Scope()) -> DataFrame:
        """Visible recordings of a scope, newest first; ``before``: (created_at, id) of the last one seen."""
        return self.sql(f"SELECT r.* FROM recordings r WHERE {library.VISIBLE} AND {scope.condition(before=before)} ORDER BY r.created_at DESC, r.id DESC LIMIT {max(1, min(int(limit), MOST_LISTED))}")

    def recording(self, id: int) -> DataFrame:
        return self.sql(f"SELECT u.id, u.utterance_index, u.start_time, u.end_time, {library.shown_name(SPARK)} AS speaker, u.text FROM utterances u LEFT JOIN speakers s ON s.uuid = u.speaker_uuid JOIN recordings r ON r.id = u.recording_id WHERE u.recording_id = {int(id)} AND NOT u.is_hidden AND {library.VISIBLE} ORDER BY u.utterance_index")

    def search(self, query: str, mode: str | None = None, limit: int = 20, scope: Scope | None = None, vector: list[float] | None = None, like: int | None = None, fallback: bool = True, context: int = 0) -> Found:
        """Hits for a query: by words, by a vector (or the vector ``like``), or both; with ``context`` lines around each.

        Without a mode: hybrid if there are vectors, else by words. Searches stay within visible recordings of the scope.
        """
        if not query.strip() or not search.query_terms(query):
            raise ValueError("the query has no words")
        if limit <= 0:
            raise ValueError("limit must be positive")
        query, limit = query[:MOST_QUERY], min(int(limit), MOST_FOUND)
        speakers = () if scope is None else scope.speakers
        # Ids of the scope's recordings are a sub-query, not a list.
        inside = f"SELECT r.id FROM recordings r WHERE {library.VISIBLE} AND {(scope or Scope()).condition(speakers=())}"
        seen = self.sql(inside).withColumnRenamed("id", "recording_id")
        n, asked = candidate_limit(limit), vector is not None or like is not None
        ready = self.ready() and asked

        def keyword(k: int) -> DataFrame:
            if "keyword" in self.lanes:
                return self.lanes["keyword"](query, k, seen, speakers)
            stored = None if self.words is None else search.stored_views(self.words, query)
            return self.sql(search.keyword(SPARK, query, k, inside, speakers, stored))

        def semantic(k: int) -> DataFrame:
            if "semantic" in self.lanes:
                return self.lanes["semantic"](vector, k, seen, speakers)
            return self.sql(search.semantic(SPARK, vector, like if like is not None else 7, k, None, inside, speakers))

        def hybrid() -> DataFrame:
            return self.sql(search.fused(SPARK, query, vector, like if like is not None else 7, limit, inside, speakers, {"kw": keyword(n), "sem": semantic(n)}))

        alone = lambda lane: lane.where(F.col("place") <= limit).withColumn("score", F.lit(1.0) / (search.FUSION + F.col("place")))
        complete = True

        def ann() -> DataFrame:
            nonlocal complete
            if self.voices is None:  # nothing to approximate with: all are looked at
                return alone(semantic(limit))
            within = self.sql(f"SELECT e.utterance_id AS id, e.of AS of_recording FROM ({search.eligible(SPARK, inside, speakers)}) e")
            found = self.voices.search(self._vector(vector, like), limit, within)
            complete = found.complete
            lane = found.hits.withColumn("identity", F.concat(F.lit("utterance:"), F.col("id").cast("string")))
            return alone(lane.select("place", "identity", "recording_id", F.col("id").alias("utterance_id"), F.round("cosine", 6).alias("cosine")))

        mode = mode or (HYBRID if ready else KEYWORD)
        ran, hits, note = route(mode, ready, lambda: alone(keyword(limit)), lambda: alone(semantic(limit)), hybrid, fallback, ann)
        return Found(ran, self.around(hits, context) if context else hits, note, complete)

    def _vector(self, vector: list[float] | None, like: int | None) -> list[float]:
        return list(vector) if vector is not None else list(self.sql(f"SELECT q FROM {search.asked_vector(SPARK, None, like)} z").first()["q"])

    def around(self, hits: DataFrame, lines: int) -> DataFrame:
        """Hits with the visible lines up to ``lines`` places before and after each, in order."""
        shown = search.view(hits, "hits")
        near = f"SELECT h.identity, n.id, n.utterance_index, n.text, n.utterance_index < u.utterance_index AS earlier FROM {shown} h JOIN utterances u ON u.id = h.utterance_id JOIN utterances n ON n.recording_id = u.recording_id AND n.utterance_index BETWEEN u.utterance_index - {int(lines)} AND u.utterance_index + {int(lines)} AND n.utterance_index <> u.utterance_index AND NOT n.is_hidden"
        side = "transform(array_sort(collect_list(CASE WHEN {} THEN struct(utterance_index, id) END)), x -> x.id)"
        found = self.sql(f"SELECT identity, {side.format('earlier')} AS before, {side.format('NOT earlier')} AS after FROM ({near}) c GROUP BY identity")
        return hits.join(found, "identity", "left").withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("before", "after")})

    def tags(self) -> DataFrame:
        return self._run(analytics.tag_counts)

    def meeting_notes(self, recording: int) -> DataFrame:
        return self.sql(f"SELECT m.* FROM meetings m JOIN ({library.private_meetings(SPARK)}) p ON p.id = m.id JOIN recording_meetings l ON l.meeting_id = m.id AND NOT l.is_dismissed WHERE l.recording_id = {int(recording)}")

    def comments(self, recording: int, status: str | None = None) -> DataFrame:
        found = self.table("comments").where(F.col("recording_id") == int(recording))
        return found if status is None else found.where(F.col("status") == status)

    # --- writes: the next version of a relation, as a DataFrame; a sink puts it in the place of the last

    def set_title(self, recording: int, title: str) -> DataFrame:
        return self.table("recordings").withColumn("title", F.when(F.col("id") == int(recording), F.lit(title.strip())).otherwise(F.col("title")))

    def set_tags(self, recording: int, tags: tuple[str, ...]) -> DataFrame:
        """recording_tags with these tags, by name, for the recording. A name that no tag has is an error."""
        known = {r["name"].lower(): r["id"] for r in self.table("tags").where(F.lower("name").isin([t.lower() for t in tags])).collect()}
        if missing := [t for t in tags if t.lower() not in known]:
            raise ValueError(f"no such tag: {', '.join(missing)}")
        links = self.table("recording_tags")
        new = self.spark.createDataFrame([(int(recording), i) for i in sorted(set(known.values()))], "recording_id long, tag_id int")
        return links.where(F.col("recording_id") != int(recording)).unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in links.schema]))

    def write_notes(self, notes: DataFrame, event: str, agenda: str, text: str, now: float, seen: float | None = None, slack: float = 0.002) -> DataFrame:
        """notes (calendar_event_id, agenda, notes, updated_at) with a new version of one. ``seen``: the version that the
        writer had; another one by more than ``slack`` seconds, or none, is a conflict."""
        stored = notes.where(F.col("calendar_event_id") == event).select("updated_at").first()
        if seen is not None and (stored is None or abs(stored[0] - seen) > slack):
            raise Conflict(f"the notes of {event} are of {None if stored is None else stored[0]}")
        new = notes.sparkSession.createDataFrame([(event, agenda, text, float(now))], "calendar_event_id string, agenda string, notes string, updated_at double")
        return notes.where(F.col("calendar_event_id") != event).unionByName(new)

    def add_comment(self, recording: int, body: str, author: str, key: str | None = None, id: int | None = None) -> tuple[int, DataFrame]:
        """(id, comments): a new comment, or the one that is there for the author's key if it says the same; else a conflict."""
        table = self.table("comments")
        if key is not None and (old := table.where((F.col("created_by") == author) & (F.col("idempotency_key") == key)).first()):
            if old["recording_id"] != int(recording) or old["body"] != body.strip():
                raise Conflict(f"{author} has used {key} for something else")
            return old["id"], table
        new_id = (table.agg(F.max("id")).first()[0] or 0) + 1 if id is None else id
        row = {"id": new_id, "recording_id": int(recording), "body": body.strip(), "status": "open", "created_by": author, "idempotency_key": key}
        new = self.spark.createDataFrame([tuple(row.get(f.name) for f in table.schema)], table.schema)
        return new_id, table.unionByName(new)

    def set_comment(self, comment: int, status: str | None = None, body: str | None = None) -> DataFrame:
        if status not in (None, "open", "resolved"):
            raise ValueError("a comment is open or resolved")
        mine, out = F.col("id") == int(comment), self.table("comments")
        for name, value in (("status", status), ("body", None if body is None else body.strip())):
            if value is not None:
                out = out.withColumn(name, F.when(mine, F.lit(value)).otherwise(F.col(name)))
        return out

    def delete_comment(self, comment: int) -> DataFrame:
        return self.table("comments").where(F.col("id") != int(comment))
