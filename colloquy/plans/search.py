"""Keyword search, vector search, their fusion, and what is made of the hits.

Every plan takes its query: words, a vector (or a line to be like), and the recordings and speakers to stay within.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..dialect import Spark, folded
from ..index import TOKEN
from .library import VISIBLE, cosine, shown_name

FUSION = 60
#: Weights of the fields in BM25, its k1 and b.
TITLE_WEIGHT, K1, B = 5.0, 1.2, 0.75
QUERY = "de la"


def view(df, name: str) -> str:
    """A temporary view of ``df`` under a name that nothing else has."""
    own = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(own)
    return own


def stored_views(index, query: str) -> tuple[str, str]:
    """Views of the postings of a query's words and of the statistics of a stored index (:class:`colloquy.index.KeywordIndex`)."""
    manifest = index.log.version()  # both of one version
    return view(index.postings(query_terms(query), manifest), "postings"), view(index.corpus(manifest), "corpus")


def query_terms(query: str) -> list[str]:
    """The words of a query as the index has them: lower case, without marks, letters and digits."""
    import regex

    return regex.findall(TOKEN, folded(query))


def candidate_limit(limit: int) -> int:
    """How many hits each lane hands to the fusion."""
    return max(50, min(500, 3 * limit))


def among_ids(recordings: tuple | str) -> str:
    """Recordings to stay within: their ids, or a SELECT that gives them."""
    return recordings if isinstance(recordings, str) else ", ".join(str(int(r)) for r in recordings) or "NULL"


# --- the index -------------------------------------------------------------------------------------------------------


def documents(d: Spark) -> str:
    """field ('title' or 'transcript'), doc, recording_id, place_in, speaker_uuid, ws: what can be found by words."""
    words = lambda x: d.find(d.fold(x), TOKEN)
    return f"""SELECT 'transcript' AS field, id AS doc, recording_id, utterance_index AS place_in, speaker_uuid, {words("text")} AS ws FROM utterances WHERE NOT is_hidden UNION ALL
        SELECT 'title', id, id, -1, NULL, {words("title")} FROM recordings"""


def postings(d: Spark) -> str:
    source = f"(SELECT id, {d.find(d.fold('text'), TOKEN)} AS ws FROM utterances WHERE NOT is_hidden) s"
    return f"SELECT id, term, cast(place AS BIGINT) AS place FROM {d.unnest(source, 'ws', 'term', 'place')}"


def index(d: Spark) -> str:
    return f"WITH p AS ({postings(d)}) SELECT term, count(DISTINCT id) AS df, count(*) AS tf, cast(min(place) AS BIGINT) AS first_place FROM p GROUP BY term"


def tokens(d: Spark) -> str:
    return f"SELECT id, {d.size(d.find(d.fold('text'), TOKEN))} AS n, {d.at(d.find(d.fold('text'), TOKEN), '1')} AS first_token FROM utterances WHERE {d.size(d.find(d.fold('text'), TOKEN))} > 0"


def index_docs(d: Spark) -> str:
    """What a stored index is built from: the lines and the titles, as colloquy.index has them."""
    return """SELECT 'transcript' AS field, id AS doc, 1 AS version, NOT is_hidden AS visible, recording_id, utterance_index AS place_in, speaker_uuid, text FROM utterances UNION ALL
        SELECT 'title', id, 1, true, id, -1, NULL, title FROM recordings"""


def lexical(d: Spark, query: str = QUERY, limit: int = 60, recordings: tuple | str | None = None, speakers: tuple = (), stored: tuple[str, str] | None = None) -> str:
    """Common table expressions of a keyword search, down to ``found``: the hits in their order.

    Three lanes over two fields: the phrase (tier 3), all words (2), any word (1, only if the others give fewer than
    ``limit`` hits). A lane is the best ``limit`` by BM25, then date and place; statistics are those of the whole index,
    before any filter. A hit keeps its highest tier, and in it its lowest score. Titles aren't searched for speakers.

    ``stored``: views of the words' postings and of the fields' statistics from a stored index, read in the place of all texts.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query has no words")
    if limit <= 0:
        raise ValueError("limit must be positive")
    asked = ", ".join(f"({d.text(t)}, {j})" for j, t in enumerate(terms))
    among = d.texts(dict.fromkeys(terms))
    scope = ""
    if recordings is not None:
        scope += f" AND d.recording_id IN ({among_ids(recordings)})"
    if speakers:
        scope += f" AND d.field = 'transcript' AND d.speaker_uuid IN ({d.texts(speakers)})"
    weight = f"CASE WHEN field = 'title' THEN {TITLE_WEIGHT}e0 ELSE 1e0 END"
    score = lambda tf, df: f"greatest({d.ln(f'(n - {df} + 5e-1) / ({df} + 5e-1)')}, 1e-6) * ({tf} * w * {K1 + 1}e0) / ({tf} * w + {K1}e0 * ({1 - B}e0 + {B}e0 * len / mean))"
    if stored:
        base = f"""docs AS (SELECT DISTINCT field, doc, recording_id, place_in, speaker_uuid FROM {stored[0]}), corpus AS (SELECT field, n, mean FROM {stored[1]}),
        hit AS (SELECT field, doc, len, term, place FROM {d.unnest(f"(SELECT field, doc, len, term, places FROM {stored[0]}) h", "places", "place")})"""
    else:
        base = f"""docs AS ({documents(d)}),
        corpus AS (SELECT field, count(*) AS n, avg(cast({d.size("ws")} AS DOUBLE)) AS mean FROM docs GROUP BY field),
        hit AS (SELECT field, doc, len, term, place FROM {d.unnest(f"(SELECT field, doc, {d.size('ws')} AS len, ws FROM docs WHERE {d.some('ws', 'w', f'w IN ({among})')}) h", "ws", "term", "place")} WHERE term IN ({among}))"""
    return f"""asked AS (SELECT * FROM (VALUES {asked}) AS v(term, j)), {base},
        tf AS (SELECT field, doc, max(len) AS len, term, count(*) AS tf FROM hit GROUP BY field, doc, term), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
        scored AS (SELECT field, doc, count(DISTINCT term) AS kinds, -sum({score("tf", "df")}) AS bm25 FROM (
            SELECT t.field, t.doc, t.len, t.term, t.tf, f.df, c.n, c.mean, {weight.replace("field", "t.field")} AS w FROM tf t JOIN df f ON f.field = t.field AND f.term = t.term JOIN asked a ON a.term = t.term JOIN corpus c ON c.field = t.field) x GROUP BY field, doc),
        runs AS (SELECT field, doc, max(len) AS len, count(*) AS tf FROM (SELECT h.field, h.doc, max(h.len) AS len, h.place - a.j AS begun FROM hit h JOIN asked a ON a.term = h.term GROUP BY h.field, h.doc, h.place - a.j HAVING count(*) = {len(terms)}) r GROUP BY field, doc),
        phrases AS (SELECT field, doc, -({score("tf", "df")}) AS bm25 FROM (SELECT r.field, r.doc, r.len, r.tf, k.df, c.n, c.mean, {weight.replace("field", "r.field")} AS w FROM runs r JOIN (SELECT field, count(*) AS df FROM runs GROUP BY field) k ON k.field = r.field JOIN corpus c ON c.field = r.field) x),
        lanes AS (SELECT field, doc, 3 AS tier, bm25 FROM phrases UNION ALL SELECT field, doc, 2, bm25 FROM scored WHERE kinds = {len(set(terms))} UNION ALL SELECT field, doc, 1, bm25 FROM scored),
        known AS (SELECT x.field, x.doc, x.tier, x.bm25, d.recording_id, d.place_in, r.created_at, CASE WHEN x.field = 'title' THEN 'recording:' || cast(x.doc AS VARCHAR(20)) || ':title' ELSE 'utterance:' || cast(x.doc AS VARCHAR(20)) END AS identity
            FROM lanes x JOIN docs d ON d.field = x.field AND d.doc = x.doc JOIN recordings r ON r.id = d.recording_id WHERE true{scope}),
        laned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, tier ORDER BY round(bm25, 9), created_at DESC, place_in, doc) AS n FROM known) x WHERE n <= {int(limit)}),
        strong AS (SELECT count(DISTINCT identity) AS hits FROM laned WHERE tier > 1),
        merged AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY identity ORDER BY tier DESC, bm25) AS k FROM laned l CROSS JOIN strong s WHERE tier > 1 OR s.hits < {int(limit)}) x WHERE k = 1),
        found AS (SELECT *, row_number() OVER (ORDER BY tier DESC, CASE WHEN field = 'title' THEN 0 ELSE 1 END, round(bm25, 9), created_at DESC, identity) AS place FROM merged)"""


def bm25_scores(d: Spark, query: str = QUERY, stored: tuple[str, str] | None = None) -> str:
    """Scores of every line and title with a word of the query; smaller is better."""
    return f"WITH {lexical(d, query, stored=stored)} SELECT field, doc, round(bm25, 6) AS bm25 FROM scored"


def match_tiers(d: Spark, query: str = QUERY, stored: tuple[str, str] | None = None) -> str:
    """What each line and title matches: the phrase, all words, or any."""
    return f"WITH {lexical(d, query, stored=stored)} SELECT field, doc, max(tier) AS tier FROM lanes GROUP BY field, doc"


def merged_tiers(d: Spark, query: str = QUERY, limit: int = 20, stored: tuple[str, str] | None = None) -> str:
    return f"WITH {lexical(d, query, limit, stored=stored)} SELECT identity, tier, round(bm25, 6) AS bm25 FROM merged"


def lane(d: Spark, query: str = QUERY, limit: int = 60, stored: tuple[str, str] | None = None) -> str:
    return f"WITH {lexical(d, query, limit, stored=stored)} SELECT field, tier, n, identity FROM laned"


def keyword(d: Spark, query: str = QUERY, limit: int = 60, recordings: tuple | str | None = None, speakers: tuple = (), stored: tuple[str, str] | None = None) -> str:
    """Hits by words, best first: tier, then titles before lines, then score, date and the identity as a string."""
    return f"WITH {lexical(d, query, limit, recordings, speakers, stored)} SELECT place, identity, field, tier, round(bm25, 6) AS bm25, recording_id, CASE WHEN field = 'transcript' THEN doc END AS utterance_id FROM found WHERE place <= {int(limit)}"


def title_gate(d: Spark, query: str = QUERY, speakers: tuple = ("spk-user-1",), stored: tuple[str, str] | None = None) -> str:
    """The same search with and without a speaker: titles are found only without."""
    both = [f"SELECT {d.text(name)} AS asked, field, identity FROM ({keyword(d, query, 60, None, of, stored)}) k{i}" for i, (name, of) in enumerate((("all", ()), ("speaker", speakers)))]
    return " UNION ALL ".join(both)


# --- vectors ---------------------------------------------------------------------------------------------------------


def asked_vector(d: Spark, vector: list[float] | None = None, like: int = 7) -> str:
    """q: the vector that is asked for, or that of the line to be like."""
    return f"(SELECT embedding AS q FROM vectors WHERE vec_id = {int(like)})" if vector is None else f"(SELECT {d.array(*(f'cast({float(x)!r} AS DOUBLE)' for x in vector))} AS q)"


#: Vectors of visible lines.
INDEXED = "(SELECT v.*, u.recording_id AS of, u.speaker_uuid AS said_by, u.utterance_index FROM vectors v JOIN utterances u ON u.id = v.utterance_id WHERE NOT u.is_hidden)"


def eligible(d: Spark, recordings: tuple | str | None = None, speakers: tuple = ()) -> str:
    where = [] if recordings is None else [f"v.of IN ({among_ids(recordings)})"]
    if speakers:
        where.append(f"v.said_by IN ({d.texts(speakers)})")
    return f"SELECT v.* FROM {INDEXED} v WHERE {' AND '.join(where) or 'true'}"


def label_cosines(d: Spark) -> str:
    """Each voice against the first of its speaker, and against a vector of other dimensions, which gives 0."""
    return f"""SELECT v.vec_id, round({cosine(d, "v.embedding", "a.anchor")}, 6) AS cosine, {cosine(d, "v.embedding", d.array("1e0", "0e0"))} AS other FROM vectors v
        JOIN (SELECT speaker_uuid, min_by(embedding, vec_id) AS anchor FROM vectors GROUP BY speaker_uuid) a ON a.speaker_uuid = v.speaker_uuid"""


def semantic(d: Spark, vector: list[float] | None = None, like: int = 7, limit: int = 20, most: float | None = None, recordings: tuple | str | None = None, speakers: tuple = ()) -> str:
    """The nearest visible lines by exact cosine: distance = 1 - cosine, relevance = 1 - distance / 2, nearest first.

    ``most``: the greatest distance. Vectors of norm 0 or of other dimensions than the query's are left out.
    """
    c = f"greatest(-1e0, least(1e0, {cosine(d, 'v.embedding', 'z.q')}))"
    near = f"""SELECT utterance_id, vec_id, of AS recording_id, c FROM (SELECT v.utterance_id, v.vec_id, v.of, {c} AS c FROM ({eligible(d, recordings, speakers)}) v CROSS JOIN {asked_vector(d, vector, like)} z
            WHERE {d.size("v.embedding")} = {d.size("z.q")} AND {d.dot("v.embedding", "v.embedding")} > 0) t{"" if most is None else f" WHERE 1 - c <= {most}"} ORDER BY round(c, 9) DESC, vec_id LIMIT {int(limit)}"""
    return f"SELECT row_number() OVER (ORDER BY round(c, 9) DESC, vec_id) AS place, 'utterance:' || cast(utterance_id AS VARCHAR(20)) AS identity, recording_id, utterance_id, round(c, 6) AS cosine, round(1 - (1 - c) / 2, 6) AS relevance FROM ({near}) n"


def strategy(d: Spark, most: int = 20000, force: bool = False, recordings: tuple | str | None = None, speakers: tuple = ()) -> str:
    """How a search within a scope is done: exactly up to ``most`` vectors unless forced otherwise; an empty scope is complete."""
    exact = f"count(*) <= {int(most)} AND NOT {str(bool(force)).lower()}"
    return f"SELECT CASE WHEN {'true' if recordings == () else 'false'} THEN 'ann' WHEN {exact} THEN 'exact' WHEN count(*) = 0 AND NOT {str(bool(force)).lower()} THEN 'exact' ELSE 'ann' END AS strategy, ({exact}) OR count(*) = 0 AS complete, CASE WHEN {exact} THEN count(*) ELSE 0 END AS examined, count(*) AS indexed FROM ({eligible(d, recordings, speakers)}) v"


def index_coverage(d: Spark) -> str:
    """Visible lines of visible recordings and those with a vector, by recording and (recording_id null) for the library."""
    seen = f"(SELECT u.recording_id, e.utterance_id FROM utterances u JOIN (SELECT r.id FROM recordings r WHERE {VISIBLE}) r ON r.id = u.recording_id LEFT JOIN (SELECT DISTINCT utterance_id FROM vectors) e ON e.utterance_id = u.id WHERE NOT u.is_hidden)"
    counts = "count(*) AS visible, count(x.utterance_id) AS indexed, CASE WHEN count(*) = 0 THEN 1e0 ELSE round(count(x.utterance_id) * 1e0 / count(*), 6) END AS ratio"
    return f"SELECT x.recording_id, {counts} FROM {seen} x GROUP BY x.recording_id UNION ALL SELECT cast(NULL AS BIGINT), {counts} FROM {seen} x"


#: Weights of vectors in a mean, by policy.
WEIGHTS = {"equal": "1e0", "duration": "greatest(5e-2, end_time - start_time)", "quality": "greatest(5e-2, end_time - start_time) * least(1e0, greatest(5e-2, quality))"}


def centroids(d: Spark, by: str = "speaker_uuid", weight: str = "quality", source: str = "vectors", name: str = "cent") -> str:
    """Common table expressions down to ``cent``: ``by``, n, m (the weighted mean of normalised vectors, normalised),
    confidence, start_time, end_time."""
    keys = [k.strip() for k in by.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    norm = f"sqrt({d.dot('embedding', 'embedding')})"
    q = "greatest(5e-2, quality)"
    t = "greatest(5e-2, end_time - start_time)"
    return f"""{name}_x AS (SELECT {by}, w, cast(v AS DOUBLE) / norm AS v, cast(k AS BIGINT) AS k FROM {d.unnest(f"(SELECT {by}, {WEIGHTS[weight]} AS w, {norm} AS norm, embedding FROM {source} WHERE {norm} > 0) s", "embedding", "v", "k")}),
        {name}_m AS (SELECT {by}, k, sum(w * v) / sum(w) AS m FROM {name}_x GROUP BY {by}, k), {name}_n AS (SELECT {by}, sqrt(sum(m * m)) AS norm FROM {name}_m GROUP BY {by}),
        {name}_s AS (SELECT {by}, count(*) AS n, least(1e0, sum({q} * {t}) / sum({t})) AS confidence, min(start_time) AS start_time, max(end_time) AS end_time FROM {source} GROUP BY {by}),
        {name}_v AS (SELECT {", ".join(f"m.{k}" for k in keys)}, {d.gather("m.m / n.norm", "m.k")} AS m FROM {name}_m m JOIN {name}_n n ON {on("m", "n")} WHERE n.norm > 0 GROUP BY {", ".join(f"m.{k}" for k in keys)}),
        {name} AS (SELECT s.*, v.m FROM {name}_s s JOIN {name}_v v ON {on("s", "v")})"""


def weighted_mean(d: Spark, weight: str = "quality") -> str:
    """Means of each speaker's vectors by weight, one row for each dimension, and their norm taken out."""
    source = f"(SELECT speaker_uuid, m FROM cent) c"
    return f"WITH {centroids(d, weight=weight)} SELECT speaker_uuid, cast(k AS BIGINT) AS k, round(v, 6) AS v FROM {d.unnest(source, 'm', 'v', 'k')}"


def running_mean(d: Spark) -> str:
    """What adding vectors one by one to a mean comes to: the mean."""
    return f"SELECT speaker_uuid, cast(k AS BIGINT) AS k, round(avg(cast(v AS DOUBLE)), 6) AS v, count(*) AS n FROM {d.unnest('(SELECT speaker_uuid, embedding FROM vectors) s', 'embedding', 'v', 'k')} GROUP BY speaker_uuid, k"


def similar_speakers(d: Spark, speaker: str = "spk1-0", least: float = 0.7, k: int = 10) -> str:
    """Active speakers whose mean voice is like one speaker's."""
    c = cosine(d, "c.m", "z.m")
    return f"""WITH {centroids(d)} SELECT speaker_uuid, round(c, 6) AS similarity FROM (SELECT c.speaker_uuid, {c} AS c FROM cent c CROSS JOIN (SELECT m FROM cent WHERE speaker_uuid = {d.text(speaker)}) z LEFT JOIN speakers s ON s.uuid = c.speaker_uuid
        WHERE c.speaker_uuid <> {d.text(speaker)} AND coalesce(s.identity_state, 'active') = 'active') t WHERE c >= {least} ORDER BY round(c, 9) DESC, speaker_uuid LIMIT {int(k)}"""


def neighbour_cosine(d: Spark) -> str:
    return f"SELECT vec_id, CASE WHEN before IS NOT NULL THEN round({cosine(d, 'embedding', 'before')}, 6) END AS cosine FROM (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY recording_id ORDER BY vec_id) AS before FROM vectors) t"


def coerced(d: Spark, short: int = 48, long: int = 80, most: int = 3000) -> str:
    """Vectors cut or filled with zeros to a model's dimensions, and the text that goes to the model: cleaned and cut."""
    a, b = d.fit("v.embedding", short), d.fit("v.embedding", long)
    text = d.cut(f"trim({d.sub('u.text', '[ \t\n\r]+', ' ')})", "1", str(most))
    return f"SELECT v.vec_id, {d.size(a)} AS short, round({d.dot(a, a)}, 6) AS short_sum, {d.size(b)} AS long, round({d.dot(b, b)}, 6) AS long_sum, length({text}) AS chars FROM vectors v LEFT JOIN utterances u ON u.id = v.utterance_id"


def voice_check(d: Spark, margin: float = 0.05, floor: float = 0.5) -> str:
    """Each voice against its own speaker's mean and the nearest other speaker's of its recording: suspect if the other is
    nearer by ``margin`` or its own is below ``floor``, with a score."""
    return f"""WITH {centroids(d, weight="equal")}, here AS (SELECT DISTINCT recording_id, own FROM said_by q),
        c AS (SELECT x.vec_id, x.own, h.own AS other, {cosine(d, "x.embedding", "m.m")} AS c FROM said_by x JOIN here h ON h.recording_id = x.recording_id JOIN cent m ON m.speaker_uuid = h.own),
        s AS (SELECT vec_id, coalesce(max(CASE WHEN own = other THEN c END), -1) AS me, max(CASE WHEN own <> other THEN c END) AS best, min(CASE WHEN own <> other AND k = 1 THEN other END) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, own = other ORDER BY round(c, 9) DESC, other) AS k FROM c) r GROUP BY vec_id)
        SELECT vec_id, round(me, 6) AS self_, nearest, round(best, 6) AS best_other, coalesce(best > me + {margin}, false) OR (me >= 0 AND me < {floor}) AS suspect, round(greatest(0e0, coalesce(best, -1) - me) + greatest(0e0, {floor} - greatest(me, 0e0)) * 5e-1, 6) AS score FROM s"""


# --- fusion ----------------------------------------------------------------------------------------------------------


def fused(d: Spark, query: str = QUERY, vector: list[float] | None = None, like: int = 7, limit: int = 20, recordings: tuple | str | None = None, speakers: tuple = (), lanes: dict | None = None, stored: tuple[str, str] | None = None) -> str:
    """Keyword and vector lanes joined by reciprocal ranks: score, then the better rank, the date, the identity.

    ``lanes``: DataFrames of a lane's hits, kw or sem, in the place of the plans' own.
    """
    n = candidate_limit(limit)
    given = {}
    for name, df in (lanes or {}).items():
        full = df.withColumns({c: F.lit(None).cast(t) for c, t in (("field", "string"), ("tier", "int")) if c not in df.columns})
        given[name] = f"SELECT * FROM {view(full, name)}"
    part = lambda x: f"coalesce(1e0 / ({FUSION} + {x}), 0e0)"
    return f"""WITH kw AS (SELECT * FROM ({given.get("kw") or keyword(d, query, n, recordings, speakers, stored)}) a), sem AS (SELECT * FROM ({given.get("sem") or semantic(d, vector, like, n, None, recordings, speakers)}) b),
        joined AS (SELECT coalesce(k.identity, s.identity) AS identity, coalesce(k.field, 'transcript') AS field, coalesce(k.recording_id, s.recording_id) AS recording_id, coalesce(k.utterance_id, s.utterance_id) AS utterance_id, k.tier, k.place AS keyword_rank, s.place AS semantic_rank,
            {part("k.place")} + {part("s.place")} AS score FROM kw k FULL OUTER JOIN sem s ON s.identity = k.identity)
        SELECT row_number() OVER (ORDER BY round(score, 12) DESC, best, created_at DESC, identity) AS place, identity, field, recording_id, utterance_id, tier, keyword_rank, semantic_rank, CASE WHEN keyword_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'hybrid' WHEN semantic_rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS match, round(score, 9) AS score
        FROM (SELECT b.*, r.created_at, least(coalesce(keyword_rank, 9999), coalesce(semantic_rank, 9999)) AS best FROM joined b JOIN recordings r ON r.id = b.recording_id ORDER BY round(score, 12) DESC, least(coalesce(keyword_rank, 9999), coalesce(semantic_rank, 9999)), r.created_at DESC, identity LIMIT {int(limit)}) t"""


def single_lane(d: Spark, query: str = QUERY, limit: int = 20, recordings: tuple | str | None = None, speakers: tuple = (), stored: tuple[str, str] | None = None) -> str:
    return f"SELECT place, identity, field, recording_id, utterance_id, tier, round(1e0 / ({FUSION} + place), 9) AS score FROM ({keyword(d, query, candidate_limit(limit), recordings, speakers, stored)}) k WHERE place <= {int(limit)}"


def auto_mode(d: Spark) -> str:
    return f"SELECT CASE WHEN count(*) > 0 THEN 'hybrid' ELSE 'keyword' END AS mode FROM {INDEXED} v"


def two_tracks(d: Spark) -> str:
    return "SELECT recording_id, id, row_number() OVER (PARTITION BY recording_id ORDER BY start_time, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END, utterance_index) AS place FROM utterances WHERE NOT is_hidden"


def suggestions(d: Spark, speaker: str = "spk1-0", attendees: tuple = (("Ada", "spk2-0"), ("Bo", None), ("Cy", "spk-elsewhere"), ("Di", "spk1-0")), least: float = 0.0) -> str:
    """Who a voice may be: speakers with a voice like it (100 points for an attendee), attendees who are known (80) and
    those who are new (70); each speaker once, by points and title."""
    rows = ", ".join(f"({d.text(n)}, {'cast(NULL AS VARCHAR(40))' if u is None else d.text(u)})" for n, u in attendees)
    c = cosine(d, "c.m", "z.m")
    return f"""WITH {centroids(d)}, invited AS (SELECT * FROM (VALUES {rows}) AS v(name, uuid)), heard AS (SELECT c.speaker_uuid AS uuid, {c} AS c FROM cent c CROSS JOIN (SELECT m FROM cent WHERE speaker_uuid = {d.text(speaker)}) z),
        near AS (SELECT h.uuid, coalesce(i.name, nullif(s.name, ''), 'Speaker ' || {d.cut("h.uuid", "1", "8")}) AS title, CASE WHEN i.uuid IS NOT NULL THEN 1e2 ELSE 0e0 END + h.c AS score FROM heard h LEFT JOIN invited i ON i.uuid = h.uuid LEFT JOIN speakers s ON s.uuid = h.uuid WHERE h.c >= {least})
        SELECT uuid, title, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, title) AS place FROM (SELECT * FROM near UNION ALL SELECT i.uuid, i.name, CASE WHEN i.uuid IS NULL THEN 7e1 ELSE 8e1 END FROM invited i LEFT JOIN near n ON n.uuid = i.uuid WHERE n.uuid IS NULL) x"""


def quota(d: Spark, cap: int = 8) -> str:
    """Up to ``cap`` lines of each recording, with room kept for the side that is rarer: the target's, or the others'."""
    return f"""SELECT id FROM (SELECT id, target, row_number() OVER (PARTITION BY recording_id, target ORDER BY utterance_index) AS n, least(sum(CASE WHEN target THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id), greatest({cap // 2}, {cap} - sum(CASE WHEN target THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id))) AS room
        FROM (SELECT id, recording_id, utterance_index, speaker = 'user' AS target FROM utterances WHERE NOT is_hidden) l) q WHERE n <= CASE WHEN target THEN room ELSE {cap} - room END"""


def excerpt(d: Spark, around: int = 5, budget: int = 1500) -> str:
    """Lines within ``around`` places of one of the target's, from the first on, as long as they fit the budget as shown."""
    said = f"CASE WHEN u.suspicion >= 8e-1 THEN 'TARGET (Speaker ' || {d.cut('coalesce(u.speaker_uuid, u.speaker)', '1', '8')} || ')' ELSE {shown_name(d)} END || ': ' || u.text"
    return f"""WITH l AS (SELECT u.id, u.recording_id, u.utterance_index, u.suspicion >= 8e-1 AS target, length({said}) + 1 AS n FROM utterances u LEFT JOIN speakers s ON s.uuid = u.speaker_uuid),
        near AS (SELECT * FROM (SELECT *, max(CASE WHEN target THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY utterance_index RANGE BETWEEN {around} PRECEDING AND {around} FOLLOWING) AS some_ FROM l) x WHERE some_ = 1)
        SELECT id FROM (SELECT id, sum(n) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS upto FROM near) s WHERE upto <= {budget}"""


#: Plans over words, which a stored index can serve.
STORED = ("LEX-03", "LEX-04", "LEX-05", "LEX-06", "LEX-07", "LEX-08", "RNK-01", "RNK-02")

PLANS = {
    "LEX-01": index, "LEX-02": tokens, "LEX-03": bm25_scores, "LEX-04": match_tiers, "LEX-05": merged_tiers, "LEX-06": lane, "LEX-07": keyword, "LEX-08": title_gate,
    "VEC-01": label_cosines, "VEC-02": semantic, "VEC-04": strategy, "VEC-06": index_coverage, "VEC-07": weighted_mean, "VEC-08": running_mean, "VEC-10": similar_speakers, "VEC-11": neighbour_cosine, "VEC-12": coerced, "VEC-13": voice_check,
    "RNK-01": fused, "RNK-02": single_lane, "RNK-04": auto_mode, "RNK-07": two_tracks, "RNK-08": suggestions, "RNK-09": quota, "RNK-10": excerpt,
}
