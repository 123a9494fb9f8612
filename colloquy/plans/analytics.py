"""Aggregations, ordered operators, interval algebra, search, text quality, evaluation and incremental state."""

from __future__ import annotations

from ..dialect import Spark, folded
from .library import VISIBLE, WORD, cosine, overlaps
from .search import TOKEN, centroids

TALK_WORD = r"[\p{L}\p{M}\p{N}'’]*\p{L}[\p{L}\p{M}\p{N}'’]*"


def spoken(d: Spark, pattern: str = TALK_WORD) -> str:
    """speaker_uuid, recording_id, word: one row for each spoken word."""
    source = f"(SELECT id, speaker_uuid, recording_id, {d.find('lower(text)', pattern)} AS ws FROM utterances WHERE speaker_uuid IS NOT NULL AND NOT is_hidden) s"
    return f"SELECT speaker_uuid, recording_id, word FROM {d.unnest(source, 'ws', 'word')}"


# --- aggregations ---------------------------------------------------------------------------------------------------


def speaker_stats(d: Spark) -> str:
    return "SELECT s.uuid, s.name, count(u.id) AS lines, round(coalesce(sum(u.end_time - u.start_time), 0), 6) AS seconds, max(r.created_at) AS last_at FROM speakers s LEFT JOIN utterances u ON u.speaker_uuid = s.uuid AND NOT u.is_hidden LEFT JOIN recordings r ON r.id = u.recording_id GROUP BY s.uuid, s.name"


def by_source(d: Spark) -> str:
    return "SELECT source, count(*) AS recordings, round(sum(duration), 6) AS seconds FROM recordings GROUP BY source"


def durations(d: Spark) -> str:
    return "SELECT recording_id, speaker, round(sum(end_time - start_time), 6) AS seconds FROM utterances WHERE NOT is_hidden GROUP BY recording_id, speaker"


def recordings_per_speaker(d: Spark) -> str:
    return "SELECT speaker_uuid, count(DISTINCT recording_id) AS recordings FROM utterances WHERE speaker_uuid IS NOT NULL GROUP BY speaker_uuid HAVING count(DISTINCT recording_id) > 0"


def speaker_recordings(d: Spark) -> str:
    return "SELECT u.speaker_uuid, u.recording_id, r.title, count(*) AS lines FROM utterances u JOIN recordings r ON r.id = u.recording_id WHERE u.speaker_uuid IS NOT NULL GROUP BY u.speaker_uuid, u.recording_id, r.title"


def tag_counts(d: Spark) -> str:
    return f"SELECT t.id, t.name, count(x.recording_id) AS recordings, count(v.id) AS visible FROM tags t LEFT JOIN recording_tags x ON x.tag_id = t.id LEFT JOIN (SELECT r.id FROM recordings r WHERE {VISIBLE}) v ON v.id = x.recording_id GROUP BY t.id, t.name"


def link_counts(d: Spark) -> str:
    return "SELECT recording_id, count(*) FILTER (WHERE link_type = 'matched' AND NOT is_dismissed) AS matched, count(*) FILTER (WHERE link_type <> 'matched' AND NOT is_dismissed) AS suggested FROM recording_meetings GROUP BY recording_id HAVING count(*) FILTER (WHERE NOT is_dismissed) > 0"


def best_tier(d: Spark) -> str:
    return "SELECT meeting_id, max(CASE link_type WHEN 'matched' THEN 3 WHEN 'suggested' THEN 2 ELSE 1 END) AS tier FROM recording_meetings WHERE NOT is_dismissed GROUP BY meeting_id"


def owner_counts(d: Spark) -> str:
    """For each voice its recordings, and those that it made alone: with no other voice, and not imported."""
    return """SELECT u.speaker_uuid, count(*) AS recordings, count(*) FILTER (WHERE n.n = 1 AND r.source IN ('voiceMemos', 'recording')) AS solo FROM (SELECT DISTINCT recording_id, speaker_uuid FROM utterances WHERE speaker_uuid IS NOT NULL) u
        JOIN (SELECT recording_id, count(DISTINCT speaker_uuid) AS n FROM utterances WHERE speaker_uuid IS NOT NULL GROUP BY recording_id) n ON n.recording_id = u.recording_id JOIN recordings r ON r.id = u.recording_id GROUP BY u.speaker_uuid"""


def speaker_lists(d: Spark) -> str:
    return f"SELECT recording_id, {d.join_distinct('speaker_uuid', ',')} AS speakers FROM utterances GROUP BY recording_id"


def profile(d: Spark) -> str:
    """What an evaluation asks of a recording: counts over its visible lines, and what people have done to any of its lines."""
    count = lambda x: f"cast(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    seen, manual = "NOT coalesce(u.is_hidden, false)", "coalesce(u.speaker_assignment_source, '') IN ('manual', 'global_manual')"
    return f"""SELECT u.recording_id, {count(seen)} AS visible, count(DISTINCT CASE WHEN {seen} THEN coalesce(u.speaker_uuid, u.speaker) END) AS speakers, {count(f"{seen} AND {manual}")} AS manual, {count("u.review_status IN ('user_corrected', 'user_hidden', 'user_kept')")} AS human_actions,
        {count(f"{seen} AND v.utterance_id IS NOT NULL")} AS voices, {count(f"{seen} AND u.speaker_uuid IS NULL AND trim(coalesce(u.speaker, '')) = ''")} AS unassigned, {count(f"{seen} AND NOT {manual}")} AS not_manual, {count(f"{seen} AND u.speaker_reviewed_at IS NULL")} AS unreviewed,
        {count(f"{seen} AND coalesce(u.audio_source, '') = 'microphone'")} AS microphone, {count(f"{seen} AND coalesce(u.audio_source, '') = 'system'")} AS system_
        FROM utterances u LEFT JOIN (SELECT DISTINCT utterance_id FROM vectors) v ON v.utterance_id = u.id GROUP BY u.recording_id HAVING {count(seen)} > 0"""


def status(d: Spark) -> str:
    """A library as its readers may see it: visible recordings and lines, and how many of those lines have a vector."""
    return f"""WITH v AS (SELECT r.id, r.created_at FROM recordings r WHERE {VISIBLE}), u AS (SELECT x.id FROM utterances x JOIN v ON v.id = x.recording_id WHERE NOT x.is_hidden), c AS (SELECT count(*) AS lines, count(e.utterance_id) AS indexed FROM u LEFT JOIN (SELECT DISTINCT utterance_id FROM vectors) e ON e.utterance_id = u.id)
        SELECT w.recordings, w.newest, c.lines, c.indexed, CASE WHEN c.lines = 0 THEN 1e0 ELSE round(c.indexed * 1e0 / c.lines, 6) END AS coverage FROM (SELECT count(*) AS recordings, max(created_at) AS newest FROM v) w CROSS JOIN c"""


def daily(d: Spark, first: int = 1704067200, days: int = 30) -> str:
    source = f"(SELECT {d.series('0', str(days - 1))} AS ns) t"
    return f"SELECT cast(day AS BIGINT) AS day, count(r.id) AS recordings FROM (SELECT day FROM {d.unnest(source, 'ns', 'day')}) c LEFT JOIN recordings r ON floor((r.created_at - {first}) / 86400) = c.day GROUP BY day"


def relative_days(d: Spark, now: int = 1704700000) -> str:
    day = f"floor({now} / 86400)"
    week = f"({day} - ({day} + 3) % 7)"  # the first of January 1970 was a Thursday; weeks start on Monday
    own = "floor(created_at / 86400)"
    return f"SELECT CASE WHEN {own} = {day} THEN 'Today' WHEN {own} = {day} - 1 THEN 'Yesterday' WHEN {own} BETWEEN {week} AND {day} THEN 'This Week' WHEN {own} BETWEEN {day} - 30 AND {day} THEN 'This Month' ELSE 'Older' END AS bucket, count(*) AS recordings FROM recordings GROUP BY 1"


def talk_stats(d: Spark) -> str:
    """Words a minute, mean share of the words and of the time of the recordings that a speaker is in, vocabulary."""
    return f"""WITH w AS ({spoken(d)}), lines AS (SELECT recording_id, speaker_uuid, {d.size(d.find("lower(text)", TALK_WORD))} AS n, greatest(end_time - start_time, 0) AS s FROM utterances WHERE NOT is_hidden),
        per AS (SELECT recording_id, speaker_uuid, sum(n) AS n, sum(s) AS s FROM lines GROUP BY recording_id, speaker_uuid), share AS (SELECT *, sum(n) OVER (PARTITION BY recording_id) AS all_n, sum(s) OVER (PARTITION BY recording_id) AS all_s FROM per),
        kinds AS (SELECT speaker_uuid, count(DISTINCT word) AS vocabulary FROM w GROUP BY speaker_uuid)
        SELECT s.speaker_uuid, cast(sum(n) AS BIGINT) AS words, round(avg(CASE WHEN all_n > 0 THEN n * 1e0 / all_n END), 6) AS word_share, round(avg(CASE WHEN all_s > 0 THEN s / all_s END), 6) AS time_share,
            CASE WHEN sum(s) > 0 AND sum(n) > 0 THEN round(sum(n) / (sum(s) / 60), 6) END AS words_per_minute, coalesce(max(k.vocabulary), 0) AS vocabulary FROM share s LEFT JOIN kinds k ON k.speaker_uuid = s.speaker_uuid WHERE s.speaker_uuid IS NOT NULL GROUP BY s.speaker_uuid"""


def longest_monologue(d: Spark) -> str:
    """Each speaker's longest run of visible lines that nobody interrupts, by start: from the first start to the greatest end, and its
    words. Ties: the lower recording, the earlier run."""
    by = "ORDER BY start_time, utterance_index"
    return f"""WITH o AS (SELECT recording_id, speaker_uuid, start_time, end_time, {d.size(d.find("lower(text)", TALK_WORD))} AS n, row_number() OVER (PARTITION BY recording_id {by}) - row_number() OVER (PARTITION BY recording_id, speaker_uuid {by}) AS island FROM utterances WHERE NOT is_hidden),
        i AS (SELECT recording_id, speaker_uuid, island, max(end_time) - min(start_time) AS s, min(start_time) AS a, cast(sum(n) AS BIGINT) AS words FROM o WHERE speaker_uuid IS NOT NULL GROUP BY recording_id, speaker_uuid, island)
        SELECT speaker_uuid, recording_id, round(s, 6) AS seconds, words FROM (SELECT *, row_number() OVER (PARTITION BY speaker_uuid ORDER BY round(s, 9) DESC, recording_id, a) AS n FROM i) x WHERE n = 1"""


def signature_words(d: Spark, least: int = 4, top: int = 5) -> str:
    return f"""WITH w AS ({spoken(d)}), c AS (SELECT speaker_uuid, word, count(*) AS c FROM w WHERE length(word) >= 2 GROUP BY speaker_uuid, word), t AS (SELECT speaker_uuid, count(*) AS t FROM w GROUP BY speaker_uuid),
        a AS (SELECT word, sum(c) AS whole FROM c GROUP BY word), n AS (SELECT sum(t) AS whole FROM t),
        r AS (SELECT c.speaker_uuid, c.word, c.c, CASE WHEN n.whole = t.t THEN cast(c.c AS DOUBLE) ELSE (cast(c.c AS DOUBLE) / t.t) / ((cast(a.whole AS DOUBLE) - c.c + 0.5) / (cast(n.whole AS DOUBLE) - t.t)) END AS ratio FROM c JOIN t ON t.speaker_uuid = c.speaker_uuid JOIN a ON a.word = c.word CROSS JOIN n WHERE c.c >= {least})
        SELECT speaker_uuid, word, c AS uses, round(ratio, 3) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY speaker_uuid ORDER BY round(ratio, 8) DESC, c DESC, word) AS n FROM r) x WHERE n <= {top}"""


def token_stats(d: Spark) -> str:
    """Of a recording's tokens, without markers: mean and least probability, the share under 0.4, and how many there are."""
    return """SELECT recording_id, round(avg(p), 6) AS mean_p, min(p) AS min_p, round(avg(CASE WHEN p < 4e-1 THEN 1e0 ELSE 0e0 END), 6) AS low_frac, count(*) AS tokens FROM tokens WHERE p IS NOT NULL AND NOT (substring(text, 1, 2) = '[_' AND substring(text, length(text), 1) = ']') GROUP BY recording_id"""


def combine_stats(d: Spark) -> str:
    """Statistics of parts joined by their token counts, as a mergeable aggregate."""
    return "SELECT recording_id, round(sum(m * n) / sum(n), 6) AS mean_p, min(lo) AS min_p, sum(n) AS tokens FROM (SELECT recording_id, speaker, avg(suspicion) AS m, min(suspicion) AS lo, sum(n_words) AS n FROM utterances WHERE n_words > 0 GROUP BY recording_id, speaker) p GROUP BY recording_id"


def language_vote(d: Spark, requested: str = "auto") -> str:
    """The language with the most time, ties to the first by name, with the mean confidence, by time, of the lines that
    have one; a language that is asked for wins. One recording a vote."""
    if requested.strip().lower() not in ("", "auto", "auto-detected", "unknown"):
        return f"SELECT id AS recording_id, {d.text(requested.strip().lower())} AS language, cast(NULL AS DOUBLE) AS confidence, 'user_selected' AS source FROM recordings WHERE duration IS NOT NULL"
    return f"""WITH o AS (SELECT recording_id, lower(trim(language)) AS code, confidence, end_time - start_time AS s FROM heard_languages),
        t AS (SELECT recording_id, code, sum(s) AS s, sum(CASE WHEN confidence IS NOT NULL THEN confidence * s END) / nullif(sum(CASE WHEN confidence IS NOT NULL THEN s END), 0) AS confidence FROM o WHERE code <> '' AND code <> 'auto' AND s > 0 GROUP BY recording_id, code)
        SELECT recording_id, code AS language, round(confidence, 6) AS confidence, 'audio' AS source FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(s, 9) DESC, code) AS n FROM t) v WHERE n = 1"""


ISLANDS = """SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY start_time, end_time, id ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY {by} ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM turns) t"""


def union_duration(d: Spark) -> str:
    return f"SELECT recording_id, speaker, sum(b - a) AS seconds FROM (SELECT recording_id, speaker, island, min(start_time) AS a, max(end_time) AS b FROM ({ISLANDS.format(by='recording_id, speaker')}) i GROUP BY recording_id, speaker, island) m GROUP BY recording_id, speaker"


def dedup(d: Spark) -> str:
    """Recordings that repeat a file name: the first stays. Jobs that repeat a recording: the last stays."""
    return f"""SELECT 'recording' AS what, id, n = 1 AS kept FROM (SELECT id, row_number() OVER (PARTITION BY file_name ORDER BY id) AS n, count(*) OVER (PARTITION BY file_name) AS c FROM recordings) r WHERE c > 1 UNION ALL
        SELECT 'job', id, n = 1 FROM (SELECT id, row_number() OVER (PARTITION BY recording_id ORDER BY id DESC) AS n, count(*) OVER (PARTITION BY recording_id) AS c FROM {_QUEUE} q WHERE status NOT IN ('completed', 'failed', 'done')) j WHERE c > 1"""


def p95(d: Spark) -> str:
    """The value at place ceil(0.95 n) of the ordered values, by sorting each group; see :mod:`colloquy.ranks` for large ones."""
    return "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) t WHERE n = greatest(1, ceil(0.95 * c))"


def detail(d: Spark) -> str:
    return "SELECT u.recording_id, u.speaker_uuid, s.name, count(*) AS lines FROM utterances u LEFT JOIN speakers s ON s.uuid = u.speaker_uuid WHERE NOT u.is_hidden AND u.speaker_uuid IS NOT NULL GROUP BY u.recording_id, u.speaker_uuid, s.name"


def cohesion(d: Spark) -> str:
    """For each voice of a recording the mean of the lowest quarter of its vectors' cosines to its centroid."""
    return f"""WITH {centroids(d, "speaker_uuid, recording_id")}, s AS (SELECT v.speaker_uuid, v.recording_id, {cosine(d, "v.embedding", "c.m")} AS c FROM vectors v JOIN cent c ON c.speaker_uuid = v.speaker_uuid AND c.recording_id = v.recording_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY speaker_uuid, recording_id ORDER BY c) AS n, count(*) OVER (PARTITION BY speaker_uuid, recording_id) AS k FROM s)
        SELECT speaker_uuid, recording_id, max(k) AS n, round(avg(c), 6) AS cohesion FROM r WHERE n <= greatest(1, ceil(k * 25e-2)) GROUP BY speaker_uuid, recording_id"""


def cluster_centroids(d: Spark, weight: str = "quality") -> str:
    """A voice of a recording as one vector: weighted mean, its confidence and its first and last second."""
    source = "(SELECT speaker_uuid, recording_id, n, confidence, start_time, end_time, m FROM cent) c"
    return f"WITH {centroids(d, 'speaker_uuid, recording_id', weight)} SELECT speaker_uuid, recording_id, n, round(confidence, 6) AS confidence, start_time, end_time, cast(k AS BIGINT) AS k, round(v, 6) AS v FROM {d.unnest(source, 'm', 'v', 'k')}"


def prototypes(d: Spark, least: float = 0.35) -> str:
    """A vector for each speaker, recording and label from what is surely that speaker's: visible lines without overlap, of
    one active speaker, of voices that hold together and that nobody has marked as several people."""
    fine = f"""(SELECT v.* FROM vectors v LEFT JOIN utterances u ON u.id = v.utterance_id JOIN ({cohesion(d).replace("cent", "coh")}) h ON h.speaker_uuid = v.speaker_uuid AND h.recording_id = v.recording_id
        WHERE NOT coalesce(u.is_hidden, false) AND v.overlap_ratio <= 5e-2 AND v.active_speakers <= 1 AND NOT (h.n > 1 AND h.cohesion < {least}) AND NOT EXISTS (SELECT 1 FROM mixed_voices x WHERE x.recording_id = v.recording_id AND x.speaker_uuid = v.speaker_uuid))"""
    source = "(SELECT speaker_uuid, recording_id, label, n, confidence, m FROM cent) c"
    return f"WITH {centroids(d, 'speaker_uuid, recording_id, label', source=fine)} SELECT speaker_uuid, recording_id, label, n, round(confidence, 6) AS confidence, cast(k AS BIGINT) AS k, round(v, 6) AS v FROM {d.unnest(source, 'm', 'v', 'k')}"


def embedding_coverage(d: Spark) -> str:
    return "SELECT count(e.vec_id) AS indexed, count(*) AS total, round(count(e.vec_id) * 1e0 / greatest(count(*), 1), 6) AS ratio FROM utterances u LEFT JOIN vectors e ON e.utterance_id = u.id"


# --- ordered --------------------------------------------------------------------------------------------------------


def run_lengths(d: Spark) -> str:
    """How many lines in a row, up to this one, say the same; lines without letters or digits count as 1 and end a run."""
    return f"""WITH k AS (SELECT id, recording_id, utterance_index, {d.canonical("text")} AS t FROM text_lines), g AS (SELECT *, CASE WHEN t <> '' AND t = lag(t) OVER (PARTITION BY recording_id ORDER BY utterance_index) THEN 0 ELSE 1 END AS new FROM k),
        i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY utterance_index ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT id, row_number() OVER (PARTITION BY recording_id, island ORDER BY utterance_index) AS run FROM i"""


def previous_row(d: Spark) -> str:
    return "SELECT id, lag(n_words) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS words_before, lag(speaker) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS speaker_before FROM utterances"


def speaker_change(d: Spark) -> str:
    return "SELECT id, before IS DISTINCT FROM speaker AS changed FROM (SELECT id, speaker, lag(speaker) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS before FROM utterances) t"


# Policies: the longest gap to merge over, and the longest run without a speaker to bridge.
BRIDGES = {"legacy": (1.0, 5.0), "readable": (2.0, 8.0), "safe": (0.45, 1.5)}


def bridge_gaps(d: Spark, policy: str = "readable") -> str:
    """Runs of lines without a speaker between two lines of the same one: filled if the run is short, the gaps beside it
    are small, and nobody speaks at the same time in it."""
    gap, longest = BRIDGES[policy]
    w = "OVER (PARTITION BY recording_id ORDER BY utterance_index"
    first = lambda x, back: f"{'lag' if back else 'lead'}({x}) {w})"
    return f"""WITH k AS (SELECT id, recording_id, utterance_index, start_time, end_time, active, speaker AS s FROM heard_lines),
        n AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS has, {first("s", True)} AS before, {first("end_time", True)} AS before_end, {first("s", False)} AS after, {first("start_time", False)} AS after_start FROM k),
        g AS (SELECT *, sum(has) {w} ROWS UNBOUNDED PRECEDING) AS run FROM n),
        r AS (SELECT recording_id, run, min_by(before, utterance_index) AS lead_s, min_by(before_end, utterance_index) AS lead_end, max_by(after, utterance_index) AS next_s, max_by(after_start, utterance_index) AS next_start, min(start_time) AS a, max_by(end_time, utterance_index) AS b, max(active) AS active FROM g WHERE s IS NULL GROUP BY recording_id, run)
        SELECT g.id, coalesce(g.s, CASE WHEN r.lead_s = r.next_s AND greatest(r.b - r.a, 0) <= {longest} AND greatest(r.a - r.lead_end, 0) <= {gap} AND greatest(r.next_start - r.b, 0) <= {gap} AND r.active <= 1 THEN r.lead_s END) AS speaker FROM g LEFT JOIN r ON r.recording_id = g.recording_id AND r.run = g.run AND g.s IS NULL"""


def adjacent_merge(d: Spark) -> str:
    return f"SELECT recording_id, speaker, min(start_time) AS start_time, max(end_time) AS end_time FROM ({ISLANDS.format(by='recording_id, speaker')}) i GROUP BY recording_id, speaker, island"


def margins(d: Spark) -> str:
    """For each voice the nearest speaker of its library, by mean voice, and by how much it is nearer than the next."""
    return f"""WITH {centroids(d, "speaker_uuid, library_id", "equal")}, s AS (SELECT v.vec_id, c.speaker_uuid, {cosine(d, "v.embedding", "c.m")} AS c FROM vectors v JOIN cent c ON c.library_id = v.library_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, speaker_uuid) AS n FROM s)
        SELECT vec_id, max(CASE WHEN n = 1 THEN speaker_uuid END) AS best, round(max(CASE WHEN n = 1 THEN c END), 6) AS score, round(max(CASE WHEN n = 1 THEN c END) - max(CASE WHEN n = 2 THEN c END), 6) AS margin FROM r WHERE n <= 2 GROUP BY vec_id"""


def partition_interval(d: Spark) -> str:
    """A recording's time split by word mass; the last end is the recording's own."""
    w = "OVER (PARTITION BY recording_id ORDER BY utterance_index"
    return f"""SELECT id, round(whole * (run - n_words) / greatest(total, 1), 6) AS a, round(CASE WHEN last THEN whole ELSE whole * run / greatest(total, 1) END, 6) AS b FROM (SELECT id, n_words, sum(n_words) {w}) AS run, sum(n_words) OVER (PARTITION BY recording_id) AS total, max(end_time) OVER (PARTITION BY recording_id) AS whole,
        lead(id) {w}) IS NULL AS last FROM utterances) t"""


def anchor_union(d: Spark) -> str:
    """Texts put together from several lines take the time from the first start to the last end of these lines; where one
    of the lines isn't known, their time stays approximate."""
    return f"""WITH a AS (SELECT s.id, count(*) AS asked, count(u.id) AS found, min(u.start_time) AS start_time, max(u.end_time) AS end_time FROM line_supports s LEFT JOIN utterances u ON u.id = s.anchor GROUP BY s.id)
        SELECT u.id, CASE WHEN a.asked = a.found AND a.end_time > a.start_time THEN a.start_time ELSE u.start_time END AS start_time, CASE WHEN a.asked = a.found AND a.end_time > a.start_time THEN a.end_time ELSE u.end_time END AS end_time,
            CASE WHEN a.id IS NULL OR a.asked <> a.found OR a.end_time <= a.start_time THEN 'approximate' WHEN a.asked = 1 THEN 'anchor' ELSE 'anchor_union' END AS method FROM utterances u LEFT JOIN a ON a.id = u.id"""


def estimated_timing(d: Spark, words_per_minute: int = 150) -> str:
    """Lines without times: as if read one after the other at an even pace."""
    w = f"OVER (PARTITION BY recording_id ORDER BY utterance_index)"
    return f"SELECT id, round((upto - n) / {words_per_minute}e0 * 60, 6) AS start_time, round(upto / {words_per_minute}e0 * 60, 6) AS end_time FROM (SELECT id, n, sum(n) {w} AS upto FROM (SELECT id, recording_id, utterance_index, {d.size(d.find('text', WORD))} AS n FROM utterances) t) s"


def word_timing(d: Spark) -> str:
    """Words at equal steps of their line's time; the last ends with the line. The line's tokens are dealt to its words,
    what is left over to the first ones."""
    source = f"(SELECT id, start_time, end_time, utterance_index % 5 + cast(n_words AS BIGINT) AS tokens, {d.find('text', WORD)} AS ws FROM utterances) s"
    n = d.size("ws")
    return f"""SELECT id, cast(place AS BIGINT) AS place, word, round(start_time + (end_time - start_time) * place / {n}, 6) AS a, round(CASE WHEN place = {n} - 1 THEN end_time ELSE start_time + (end_time - start_time) * (place + 1) / {n} END, 6) AS b,
        cast(floor(tokens / {n}) AS BIGINT) + CASE WHEN place < tokens % {n} THEN 1 ELSE 0 END AS tokens FROM {d.unnest(source, "ws", "word", "place")}"""


def silence(d: Spark, least: int = 2, below: int = 45) -> str:
    """Windows of a track under a level; islands of at least ``least`` windows that end before the last one give their middle."""
    return f"""WITH e AS (SELECT user_id AS track, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), b AS (SELECT track, floor(n / 4e0) AS win, avg(value) AS level FROM e GROUP BY 1, 2), q AS (SELECT *, level < {below} AS quiet, max(win) OVER (PARTITION BY track) AS last FROM b),
        i AS (SELECT *, win - row_number() OVER (PARTITION BY track ORDER BY win) AS island FROM q WHERE quiet) SELECT track, cast(min(win) AS DOUBLE) AS first_window, (min(win) + max(win) + 1) / 2e0 AS middle FROM i GROUP BY track, island HAVING count(*) >= {least} AND max(win) < max(last)"""


# --- intervals ------------------------------------------------------------------------------------------------------


def sweep(d: Spark, source: str = "turns") -> str:
    """Common table expressions down to ``active``: the stretches between two boundaries of a recording, with how many
    speakers are active in each (n) and the one if it is one (sole)."""
    cell = "(SELECT recording_id, a AS start_time, b AS end_time FROM cells WHERE b IS NOT NULL)"
    return f"""edges AS (SELECT DISTINCT recording_id, t FROM (SELECT recording_id, start_time AS t FROM {source} q UNION ALL SELECT recording_id, end_time FROM {source} q) x),
        cells AS (SELECT recording_id, t AS a, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS b FROM edges),
        active AS (SELECT l.recording_id, l.start_time AS a, l.end_time AS b, count(DISTINCT r.speaker) AS n, min(r.speaker) AS sole FROM {overlaps(d, cell, source, 16)} WHERE r.start_time < l.end_time AND r.end_time > l.start_time GROUP BY l.recording_id, l.start_time, l.end_time)"""


def overlap_evidence(d: Spark) -> str:
    return f"WITH {sweep(d)} SELECT recording_id, round(sum(CASE WHEN n >= 2 THEN b - a ELSE 0 END) * 1e0 / sum(b - a), 6) AS ratio, max(n) AS most FROM active GROUP BY recording_id"


def exclusive_spans(d: Spark) -> str:
    return f"""WITH {sweep(d)}, s AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY recording_id, sole ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM active WHERE n = 1),
        i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, sole ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT recording_id, sole AS speaker, min(a) AS a, max(b) AS b FROM i GROUP BY recording_id, sole, island"""


def clip(d: Spark, a: float = 40.0, b: float = 100.0) -> str:
    """The part of each turn within [a, b], and the parts outside."""
    return f"""SELECT id, 'in' AS part, greatest(start_time, {a}) AS a, least(end_time, {b}) AS b FROM turns WHERE start_time < {b} AND end_time > {a} UNION ALL
        SELECT id, 'before', start_time, least(end_time, {a}) FROM turns WHERE start_time < {a} UNION ALL SELECT id, 'after', greatest(start_time, {b}), end_time FROM turns WHERE end_time > {b}"""


def material_speakers(d: Spark, width: int = 12) -> str:
    """Speakers with a part worth hearing in each target (windows of ``width`` seconds): the union of their turns, cut to
    the target, lasts at least min(0.60, max(0.24, 5 % of the target))."""
    clipped = d.unnest(f"(SELECT id, recording_id, speaker, start_time, end_time, {d.series(f'floor(start_time / {width})', f'floor((end_time - 1e-9) / {width})')} AS ts FROM turns) t", "ts", "target")
    return f"""WITH c AS (SELECT id, recording_id, speaker, target, greatest(start_time, target * {width}) AS start_time, least(end_time, (target + 1) * {width}) AS end_time FROM {clipped}), {_islands("c", "recording_id, target, speaker")}
        SELECT recording_id, cast(target AS BIGINT) AS target, speaker FROM (SELECT recording_id, target, speaker, sum(b - a) AS s FROM merged GROUP BY recording_id, target, speaker) u WHERE s >= least(6e-1, greatest(24e-2, 5e-2 * {width}))"""


def _islands(source: str, by: str) -> str:
    return f"""{source}_new AS (SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY {by} ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {source}),
        {source}_i AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY start_time, end_time, id ROWS UNBOUNDED PRECEDING) AS island FROM {source}_new), merged AS (SELECT {by}, min(start_time) AS a, max(end_time) AS b FROM {source}_i GROUP BY {by}, island)"""


def material_overlap(d: Spark, least: float = 0.2) -> str:
    return f"SELECT DISTINCT l.recording_id, l.speaker AS one, r.speaker AS other FROM {overlaps(d, 'turns', 'turns', 16)} WHERE l.speaker < r.speaker AND least(l.end_time, r.end_time) - greatest(l.start_time, r.start_time) > {least}"


# --- lexical search -------------------------------------------------------------------------------------------------


# --- text -----------------------------------------------------------------------------------------------------------


def canonical_text(d: Spark) -> str:
    return f"SELECT id, {d.canonical('text')} AS text FROM text_lines"


def trimmed_words(d: Spark) -> str:
    words = d.trimmed("lower(text)")
    return f"SELECT id, {d.size(words)} AS n, {d.size(d.distinct(words))} AS kinds FROM text_lines"


def letter_words(d: Spark) -> str:
    return f"SELECT id, {d.size(d.find('text', TALK_WORD))} AS n FROM text_lines"


def word_set(d: Spark, text: str = "text") -> str:
    return d.distinct(d.kept(d.find(f"lower({text})", TOKEN), "w", "length(w) > 1"))


def word_sets(d: Spark) -> str:
    return f"SELECT id, {d.size(word_set(d))} AS n FROM text_lines"


def jaccard(d: Spark) -> str:
    both, any_ = d.size(d.common("a", "b")), d.size(d.union("a", "b"))
    return f"SELECT id, CASE WHEN {d.size('a')} = 0 OR {d.size('b')} = 0 THEN 0.0 ELSE round({both} * 1.0 / {any_}, 6) END AS jaccard FROM (SELECT id, {word_set(d)} AS a, {word_set(d, 'before')} AS b FROM (SELECT id, text, lag(text) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS before FROM text_lines) l WHERE before IS NOT NULL) t"


def trigrams(d: Spark, text: str) -> str:
    return d.grams(text, 3)


def trigram_counts(d: Spark) -> str:
    return f"SELECT id, {d.size(trigrams(d, 'text'))} AS n FROM text_lines"


#: Texts with fewer trigrams aren't compared by them.
FEWEST = 8


def trigram_pairs(d: Spark, least: float, cover: float = 0.0) -> str:
    """Common table expressions down to ``pairs``: lines and exemplars (id, ex, n, m, shared: trigrams of either and of both)
    whose overlap, shared / min(n, m), is ``least`` or more.

    Of the side with fewer trigrams at least a share of ``least`` is in the other; so one of its rarest (by the exemplars),
    more than the rest that may be missing, is. Only these are joined with all of the other side; trigrams that no exemplar has
    come first in that order and are only counted. ``cover``: the share of the line that the exemplar must cover besides, so it
    has at least as large a share of the line's number of trigrams.
    """
    most = f"(SELECT max({d.size('gs')}) FROM ex)"
    short = f" AND {d.size('gs')} * {cover} <= {most}" if cover else ""
    wide = f" AND e.n >= {cover} * l.n" if cover else ""
    rare = lambda x, n: f"SELECT id, n, g FROM (SELECT q.id, q.n, q.g, row_number() OVER (PARTITION BY q.id ORDER BY f.c, q.g) AS k, count(*) OVER (PARTITION BY q.id) AS known FROM {x} q JOIN freq f ON f.g = q.g) r WHERE k <= known - ceil({least} * {n}) + 1"
    return f"""ln AS (SELECT id, recording_id, t, s, gs FROM line_texts), ex AS (SELECT id, text AS t, {trigrams(d, "text")} AS gs FROM exemplars),
        lk AS (SELECT id, gs FROM ln WHERE {d.size('gs')} >= {FEWEST}{short}), ek AS (SELECT id, gs FROM ex WHERE {d.size('gs')} >= {FEWEST}),
        lg AS (SELECT id, n, g FROM {d.unnest(f"(SELECT id, {d.size('gs')} AS n, gs FROM lk) a", "gs", "g")}), eg AS (SELECT id, n, g FROM {d.unnest(f"(SELECT id, {d.size('gs')} AS n, gs FROM ek) a", "gs", "g")}),
        freq AS (SELECT g, count(*) AS c FROM eg GROUP BY g), cand AS (SELECT DISTINCT l.id, e.id AS ex FROM ({rare(f"(SELECT * FROM lg WHERE n <= {most})", "n")}) l JOIN eg e ON e.g = l.g AND l.n <= e.n UNION SELECT DISTINCT l.id, e.id FROM ({rare("eg", "n")}) e JOIN lg l ON l.g = e.g AND e.n < l.n{wide}),
        pairs AS (SELECT * FROM (SELECT c.id, c.ex, {d.size("l.gs")} AS n, {d.size("e.gs")} AS m, {d.size(d.common("l.gs", "e.gs"))} AS shared FROM cand c JOIN lk l ON l.id = c.id JOIN ek e ON e.id = c.ex) p WHERE shared >= {least} * least(n, m))"""


def overlap_coefficient(d: Spark, least: float = 0.65) -> str:
    """Lines and exemplars with an overlap of their trigrams (shared / the fewer) of ``least`` or more."""
    return f"WITH {trigram_pairs(d, least)} SELECT id, ex, round(shared * 1e0 / least(n, m), 6) AS overlap FROM pairs"


def coverage(d: Spark, least: float = 0.65) -> str:
    """For the same pairs, how much of the line the exemplar covers."""
    return f"WITH {trigram_pairs(d, least)} SELECT id, ex, round(shared * 1e0 / n, 6) AS coverage FROM pairs"


def ngram_evidence(d: Spark) -> str:
    """How many of a line's folded character pairs and triples the lines before and after it have between them."""
    plain = lambda x: d.sub(f"trim({d.sub(d.fold(x), '[^\\p{L}\\p{N}]+', ' ')})", " +", " ")
    grams = d.grams
    w = "OVER (PARTITION BY recording_id ORDER BY utterance_index)"
    part = lambda n: f"CASE WHEN {d.size(grams('t', n))} = 0 THEN 0e0 ELSE round({d.size(d.common(grams('t', n), d.union(grams('a', n), grams('b', n))))} * 1e0 / {d.size(grams('t', n))}, 6) END"
    return f"SELECT id, {part(2)} AS pairs, {part(3)} AS triples FROM (SELECT id, t, coalesce(lag(t) {w}, '') AS a, coalesce(lead(t) {w}, '') AS b FROM (SELECT id, recording_id, utterance_index, {plain('text')} AS t FROM text_lines) l) g"


# What subtitles say that nobody spoke.
MARKERS = ("amara.org", "btistudios", "undertexter av", "teksting av", "subtitles by", "subtitling by", "subtitled by", "subs by")


PHRASES = (
    "tack för att du har tittat", "tack för att ni har tittat", "tack för att du tittade", "thanks for watching", "thank you for watching", "like and subscribe", "prenumerera på kanalen", "glöm inte att prenumerera", "översättning av", "översatt av", "svensktextning", "nordiskt undertextat",
)


NOISE = ("musik", "music", "applåder", "applause", "skratt", "laughter", "blank_audio", "tystnad", "silence")


CREDIT_WORDS, URL_WORDS = 24, 8


def is_credit(d: Spark, text: str = "lower(text)", words: str | None = None) -> str:
    """Whether a line is a subtitle's credit and nothing else: it has a marker and few words, or the marker twice."""
    words = words or d.size(d.trimmed(text))
    twice = lambda m: f"length({text}) - length(replace({text}, {d.text(m)}, '')) >= {2 * len(m)}"
    one = [f"(contains({text}, {d.text(m)}) AND ({words} <= {CREDIT_WORDS} OR {twice(m)}))" for m in PHRASES]
    any_marker = " OR ".join(f"contains({text}, {d.text(m)})" for m in MARKERS)
    return f"((({any_marker}) AND ({words} <= {CREDIT_WORDS} OR {' OR '.join(map(twice, MARKERS))})) OR {' OR '.join(one)} OR ({words} <= {CREDIT_WORDS} AND contains({text}, 'copyright') AND contains({text}, 'sdi media')) OR (contains({text}, 'www.') AND {words} <= {URL_WORDS}))"


def boilerplate(d: Spark) -> str:
    """Credits, and longer lines that hold one."""
    words = d.size(d.trimmed("t"))
    held = " OR ".join([*(f"contains(t, {d.text(m)})" for m in (*MARKERS, *PHRASES)), "(contains(t, 'copyright') AND contains(t, 'sdi media'))"])
    credit = is_credit(d, "t", "n")
    return f"SELECT id, kind FROM (SELECT id, CASE WHEN {credit} THEN 'credit' WHEN n > {CREDIT_WORDS} AND ({held}) THEN 'embedded' END AS kind FROM (SELECT id, t, {words} AS n FROM (SELECT id, lower(text) AS t FROM text_lines) l) w) k WHERE kind IS NOT NULL"


def bare(d: Spark, text: str = "lower(text)") -> str:
    """A line without the marks of noise, in brackets or between asterisks."""
    for word in NOISE:
        text = f"replace(replace({text}, '[{word}]', ''), '({word})', '')"
    return d.sub(text, "[*][^*\\n]{1,30}[*]", "")


def symbols_only(d: Spark) -> str:
    return f"SELECT id, NOT {d.matches(bare(d), '[\\p{L}\\p{N}]')} AS empty FROM text_lines"


def silence_filler(d: Spark) -> str:
    """A word or three around a run of four dots, whatever white space is between them."""
    dots = d.sub("replace(lower(text), '…', '...')", "[ \t\n\r]+", "")
    kinds = d.size(d.distinct(d.trimmed("lower(text)")))
    return f"SELECT id, {kinds} BETWEEN 1 AND 3 AND {d.matches(dots, '[.]{4}')} AS filler FROM text_lines"


# Ranges of the scripts that are told apart.
SCRIPTS = {
    "latin": "A-Za-z\\u00AA\\u00BA\\u00C0-\\u024F\\u1E00-\\u1EFF", "cjk": "\\u4E00-\\u9FFF\\u3400-\\u4DBF\\u3040-\\u30FF\\u31F0-\\u31FF", "hangul": "\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F", "cyrillic": "\\u0400-\\u052F", "arabic": "\\u0600-\\u06FF\\u0750-\\u077F", "hebrew": "\\u0590-\\u05FF", "thai": "\\u0E00-\\u0E7F",
    "devanagari": "\\u0900-\\u097F", "greek": "\\u0370-\\u03FF",
}


def script_steps(d: Spark) -> list[str]:
    """What tells lines of another script than their recording's, in steps: select lists that each add to the columns before (text,
    recording_id, n: the number of words), down to ``outlier``."""
    ranges = {k: v.encode().decode("unicode_escape") for k, v in SCRIPTS.items()}
    names = list(ranges)
    top = lambda p, whole: "CASE " + " ".join(f"WHEN {p}{k} = greatest({', '.join(p + x for x in names)}) THEN '{k}'" for k in names) + " END"
    most, line = f"greatest({', '.join('r_' + k for k in names)})", f"greatest({', '.join(names)})"
    return [
        f"{d.sub('text', '[^\\p{L}]', '')} AS letters_", ", ".join(f"length(letters_) - length({d.sub('letters_', f'[{v}]', '')}) AS {k}" for k, v in ranges.items()), ", ".join(f"sum({k}) OVER (PARTITION BY recording_id) AS r_{k}" for k in names), f"{' + '.join('r_' + k for k in names)} AS r_all, {' + '.join(names)} AS own",
        f"r_all >= 20 AND {most} * 1e0 / greatest(r_all, 1) >= 6e-1 AND n <= 8 AND own >= 2 AND {line} * 1e0 / greatest(own, 1) >= 7e-1 AND {top('', 'own')} <> {top('r_', 'r_all')} AS outlier",
    ]


def script_outlier(d: Spark) -> str:
    """Short lines whose letters are mostly of another script than the recording's, if the recording has one."""
    found = f"SELECT id, recording_id, text, {d.size(d.trimmed('lower(text)'))} AS n FROM text_lines"
    for k, step in enumerate(script_steps(d)):
        found = f"SELECT *, {step} FROM ({found}) s{k}"
    return f"SELECT id, outlier FROM ({found}) o"


def char_rate(d: Spark) -> str:
    n = "length(trim(text))"
    return f"SELECT id, CASE WHEN s >= 1 AND {n} / s > 50 THEN 'impossible' WHEN s >= 1 AND {n} / s > 35 THEN 'fast' WHEN s > 12 AND {n} / s < 0.8 THEN 'sparse' ELSE 'normal' END AS rate FROM (SELECT id, text, greatest(end_time - start_time, 0) AS s FROM text_lines) t"


# Presets of the sweep: overlap, coverage, characters a second, cosine.
TUNINGS = {"strict": (0.85, 0.65, 1.0, 0.95), "balanced": (0.75, 0.5, 1.5, 0.92), "eager": (0.65, 0.35, 3.0, 0.87)}


#: Exemplars as long as this are distinctive: they need no quiet audio beside them.
DISTINCTIVE = 15


def gate(exemplar: str, said: str, seconds: str, rate: float) -> str:
    return f"(length({exemplar}) >= {DISTINCTIVE} OR ({seconds} >= 1 AND length({said}) * 1e0 / {seconds} < {rate}))"


def exemplar_sweep(d: Spark, mark: int = 0, tuning: str = "balanced") -> str:
    """Lines that are like an exemplar with an id over ``mark``: the same text where the gate lets it through, else the
    first one that overlaps the line and covers enough of it."""
    overlap, cover, rate, _ = TUNINGS[tuning]
    return f"""WITH {trigram_pairs(d, overlap, cover)}, exact AS (SELECT l.id, e.id AS ex FROM ln l JOIN ex e ON e.t = l.t WHERE e.id > {int(mark)} AND {gate("e.t", "l.t", "l.s", rate)}),
        near AS (SELECT p.id, min(p.ex) AS ex FROM pairs p LEFT JOIN exact x ON x.id = p.id WHERE x.id IS NULL AND p.ex > {int(mark)} AND p.shared >= {cover} * p.n GROUP BY p.id)
        SELECT id, ex, 'exact' AS kind FROM exact UNION ALL SELECT id, ex, 'trigram' FROM near"""


def embedding_sweep(d: Spark, k: int = 30, tuning: str = "balanced") -> str:
    """Voices as exemplars: of the ``k`` nearest of each in its library those that are near enough and pass the gate."""
    _, _, rate, floor = TUNINGS[tuning]
    c = cosine(d, "e.embedding", "v.embedding")
    text = d.canonical("u.text")
    return f"""SELECT exemplar, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY exemplar ORDER BY round(c, 9) DESC, vec_id) AS n FROM (
          SELECT e.vec_id AS exemplar, e.text AS said, v.vec_id, v.utterance_id, v.end_time - v.start_time AS s, {c} AS c FROM voice_exemplars e JOIN vectors v ON v.library_id = e.library_id AND v.vec_id <> e.vec_id) p) t
        LEFT JOIN utterances u ON u.id = t.utterance_id WHERE n <= {k} AND c >= {floor} AND {gate("said", f"coalesce({text}, '')", "s", rate * 100)}"""


def name_tokens(d: Spark, name: str, email: str) -> str:
    """What a person is called: parts of the name and of what is before the @, folded, of two letters or more."""
    local = d.group(email, "^([^@]*)", 1)
    return d.distinct(d.kept(d.find(d.fold(f"coalesce({name}, '') || ' ' || coalesce({local}, '')"), r"[\p{L}\p{N}]+"), "w", "length(w) >= 2"))


def mentions(d: Spark) -> str:
    """Lines in which a person's name or mail name occurs as a whole word."""
    people = f"(SELECT s.uuid, {name_tokens(d, 's.name', 'm.email')} AS ws FROM speakers s LEFT JOIN attendee_mappings m ON m.speaker_uuid = s.uuid UNION ALL SELECT 'guest-' || cast(item AS VARCHAR(9)), {name_tokens(d, 'name', 'email')} FROM (VALUES (1, 'La Évan', 'de.anna@example.com'), (2, cast(NULL AS VARCHAR(9)), 'the@example.com')) AS g(item, name, email)) n"
    said = f"(SELECT id, {d.distinct(d.find(d.fold('text'), r'[\p{L}\p{N}_]+'))} AS ts FROM utterances) u"
    return f"SELECT DISTINCT u.id, n.uuid FROM (SELECT id, said FROM {d.unnest(said, 'ts', 'said')}) u JOIN (SELECT uuid, called FROM {d.unnest(people, 'ws', 'called')}) n ON n.called = u.said"


# How people say their names.
INTRODUCTIONS = ("my name is", "mitt namn är", "jag heter")


def introductions(d: Spark, probes: tuple = INTRODUCTIONS, cap: int = 5) -> str:
    """The first ``cap`` different lines of a recording with one of the probes in them."""
    hit = " OR ".join(f"contains({d.fold('text')}, {d.text(folded(p))})" for p in probes)
    return f"""SELECT recording_id, id FROM (SELECT recording_id, id, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_index) AS n FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker, text ORDER BY utterance_index) AS k FROM utterances WHERE {hit}) x WHERE k = 1) t WHERE n <= {cap}"""


# What a model says when it can't hear.
REFUSALS = ("no audio file", "audio is not attached", "provide the audio", "upload the audio", "i cannot transcribe", "i can't transcribe", "i’m unable to transcribe")


def safe_repair(d: Spark, chars: float = 1.5, words: float = 1.5) -> str:
    """Whether a proposed text may take the place of a line: not empty, no control marks, no refusal, and not much longer
    than the longer of the line and the one after it."""
    plain = lambda x: d.find(f"lower({x})", "[\\p{L}\\p{M}\\p{N}]+")
    refused = " OR ".join(f"contains(lower(p), {d.text(m)})" for m in REFUSALS)
    longest = lambda f: f"greatest({f('a')}, {f('b')})"
    return f"""SELECT id, length(p) > 0 AND NOT contains(p, '<|') AND NOT ({refused}) AND {d.size(plain("p"))} > 0 AND length(p) <= greatest(80, cast(floor({longest(lambda x: f"length({x})")} * {chars}) AS BIGINT) + 32)
          AND {d.size(plain("p"))} <= greatest(12, cast(floor({longest(lambda x: d.size(plain(x)))} * {words}) AS BIGINT) + 4) AS safe
        FROM (SELECT l.id, trim(l.text) AS a, trim(r.proposed) AS p, l.b FROM (SELECT id, text, coalesce(trim(lead(text) OVER (PARTITION BY recording_id ORDER BY utterance_index)), '') AS b FROM text_lines) l JOIN repairs r ON r.id = l.id) t WHERE length(a) > 0 OR length(b) > 0"""


def verdict_action(d: Spark) -> str:
    """What a listener's verdict on a line leads to."""
    return f"""SELECT id, CASE WHEN {d.starts("coalesce(review_status, '')", "'user_'")} THEN 'skip' WHEN NOT (confidence = 'high' AND NOT clamped) THEN 'pending' WHEN verdict = 'correct' THEN 'verified' WHEN verdict = 'not_spoken' THEN 'hide'
          WHEN length(trim(heard)) > 0 AND NOT contains(heard, '{{') AND NOT contains(heard, '}}') AND length(trim(heard)) * 1e0 / greatest(length(trim(text)), 1) BETWEEN 3e-1 AND 3 THEN 'rewrite' ELSE 'pending' END AS action
        FROM (SELECT u.id, u.text, u.review_status, v.confidence, v.clamped, v.verdict, v.heard FROM utterances u JOIN listener_verdicts v ON v.utterance_id = u.id) t"""


def mic_track(d: Spark) -> str:
    """The meeting's stamp in the name of a file that holds the microphone's track of one; '' for others."""
    return f"SELECT id, {d.group('file_name', '^meeting_([0-9]+)_mic', 1)} AS stamp FROM recordings"


def same_person(d: Spark) -> str:
    """Names that are one person's: the words of one (of more than one letter; of a mail address what is before the @) are
    all in the other. A person shares a word with whoever it is the same as, so people are joined on words."""
    toks = d.distinct(d.kept(d.find(d.group(d.fold("called"), "^([^@]*)", 1), r"[\p{L}\p{N}]+"), "w", "length(w) > 1"))
    has = d.size(d.common("x.ws", "y.ws"))
    return f"""WITH k AS (SELECT uuid, {toks} AS ws FROM people WHERE called IS NOT NULL), t AS (SELECT uuid, w FROM {d.unnest("k", "ws", "w")}),
        c AS (SELECT DISTINCT x.uuid AS a, y.uuid AS b FROM t x JOIN t y ON x.w = y.w AND x.uuid < y.uuid) SELECT c.a, c.b FROM c JOIN k x ON x.uuid = c.a JOIN k y ON y.uuid = c.b WHERE {has} = {d.size("x.ws")} OR {has} = {d.size("y.ws")}"""


# --- identity, evaluation, state ------------------------------------------------------------------------------------


#: What a meeting counts for by the confidence of its link.
MEETING_WEIGHT = "CASE max(CASE l.link_type WHEN 'matched' THEN 2 WHEN 'suggested' THEN 1 ELSE 0 END) WHEN 2 THEN 1e0 WHEN 1 THEN 6e-1 ELSE 3e-1 END"
#: Who an attendee is: the address in lower case, else the name; null without either.
ATTENDEE_KEY = "nullif(coalesce(nullif(lower(trim(email)), ''), lower(trim(name))), '')"


def meeting_weights(d: Spark) -> str:
    """Meetings with a recording in which somebody speaks, by the best of their links that nobody has dismissed."""
    return f"SELECT l.meeting_id, {MEETING_WEIGHT} AS w FROM recording_meetings l JOIN (SELECT DISTINCT recording_id FROM utterances WHERE speaker_uuid IS NOT NULL) u ON u.recording_id = l.recording_id WHERE NOT l.is_dismissed GROUP BY l.meeting_id"


def coverage_scores(d: Spark) -> str:
    """How an attendee's meetings go with a voice's, by the meetings' weights: coverage, the share of the voice's meetings; specificity,
    the share of the attendee's; rank, coverage by the number of meetings that both were in."""
    return f"""WITH m AS ({meeting_weights(d)}),
        vm AS (SELECT DISTINCT m.meeting_id, m.w, u.speaker_uuid AS voice FROM m JOIN recording_meetings l ON l.meeting_id = m.meeting_id AND NOT l.is_dismissed JOIN utterances u ON u.recording_id = l.recording_id AND u.speaker_uuid IS NOT NULL),
        am AS (SELECT DISTINCT m.meeting_id, m.w, a.person FROM m JOIN (SELECT meeting_id, {ATTENDEE_KEY} AS person FROM attendees) a ON a.meeting_id = m.meeting_id AND a.person IS NOT NULL),
        vw AS (SELECT voice, sum(w) AS w, count(*) AS total FROM vm GROUP BY voice), aw AS (SELECT person, sum(w) AS w FROM am GROUP BY person),
        c AS (SELECT vm.voice, am.person, sum(vm.w) AS w, count(*) AS shared FROM vm JOIN am ON am.meeting_id = vm.meeting_id GROUP BY vm.voice, am.person)
        SELECT c.voice, c.person, c.shared, vw.total, round(c.w / vw.w, 6) AS coverage, round(c.w / aw.w, 6) AS specificity, round(c.w / vw.w * c.shared, 6) AS rank FROM c JOIN vw ON vw.voice = c.voice JOIN aw ON aw.person = c.person"""


def owner(d: Spark) -> str:
    """The voice with the most solo and other recordings; nobody if two have as many, or none has any."""
    return f"WITH c AS ({owner_counts(d)}), r AS (SELECT speaker_uuid, 2 * solo + recordings AS score FROM c), b AS (SELECT max(score) AS score FROM r) SELECT CASE WHEN count(*) = 1 AND min(r.score) > 0 THEN min(speaker_uuid) END AS owner FROM r JOIN b ON b.score = r.score"


def verdicts(d: Spark) -> str:
    """What stored verdicts do to guesses: agreement promotes by a tier and gives a score of 0.9 at least; contradiction
    demotes and adds a row for the person who was heard. Verdicts of low confidence, or without a person, do nothing."""
    acts = "confidence = 'high' AND heard IS NOT NULL"
    return f"""SELECT uuid, name, CASE WHEN {acts} AND lower(heard) = lower(name) THEN least(tier + 1, 2) WHEN {acts} THEN 0 ELSE tier END AS tier, round(CASE WHEN {acts} AND lower(heard) = lower(name) THEN greatest(score, 9e-1) ELSE score END, 6) AS score FROM guesses UNION ALL
        SELECT uuid, heard, 1, 7e-1 FROM guesses WHERE {acts} AND lower(heard) <> lower(name)"""


def owner_likeness(d: Spark, owner: str = "spk1-0", least: float = 0.6) -> str:
    """Voices that are so like the owner's mean voice that they are the owner's."""
    return f"WITH {centroids(d)} SELECT v.vec_id, {cosine(d, 'v.embedding', 'z.m')} >= {least} AS you FROM vectors v CROSS JOIN (SELECT m FROM cent WHERE speaker_uuid = {d.text(owner)}) z"


def aliases(d: Spark) -> str:
    """Follow aliases to whom they stand for, to the end; a circle ends at its first id that comes again."""
    return """WITH RECURSIVE links AS (SELECT id, canonical_id AS up FROM aliases WHERE identity_state = 'alias' AND canonical_id IS NOT NULL),
        walk AS (SELECT id, id AS at_, ',' || cast(id AS VARCHAR(4000)) || ',' AS seen, 0 AS steps, false AS done FROM aliases UNION ALL SELECT w.id, l.up, w.seen || cast(l.up AS VARCHAR(20)) || ',', w.steps + 1, contains(w.seen, ',' || cast(l.up AS VARCHAR(20)) || ',') FROM walk w JOIN links l ON l.id = w.at_ WHERE NOT w.done)
        SELECT id, max_by(at_, steps) AS canonical FROM walk GROUP BY id"""


def cohort_features(d: Spark) -> str:
    """Cosines of voices of different recordings, and how far they stand out from what either voice has with the others of
    its library: the mean of both z-scores, held within 6. Deviations are at least 0.025; a second look at the cohort
    leaves out what is two deviations off."""
    c = cosine(d, "a.embedding", "b.embedding")
    good = "(SELECT * FROM vectors WHERE reliable)"
    stat = lambda where: f"SELECT a, count(*) AS n, avg(c) AS m, CASE WHEN count(*) > 1 THEN greatest(25e-3, stddev_samp(c)) ELSE 1e0 END AS s FROM ({where}) q GROUP BY a"
    return f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {c} AS c FROM {good} a JOIN {good} b ON b.library_id = a.library_id AND b.recording_id <> a.recording_id), one AS ({stat("SELECT a, c FROM p")}),
        two AS ({stat("SELECT p.a, p.c FROM p JOIN one o ON o.a = p.a WHERE p.c BETWEEN o.m - 2 * o.s AND o.m + 2 * o.s")}), st AS (SELECT o.a, CASE WHEN t.n >= 3 THEN t.m ELSE o.m END AS m, CASE WHEN t.n >= 3 THEN t.s ELSE o.s END AS s FROM one o LEFT JOIN two t ON t.a = o.a)
        SELECT p.a, p.b, round(p.c, 6) AS cosine, round(greatest(-6e0, least(6e0, ((p.c - x.m) / x.s + (p.c - y.m) / y.s) / 2)), 4) + 0e0 AS z FROM p JOIN st x ON x.a = p.a JOIN st y ON y.a = p.b WHERE p.a < p.b"""


def error_rates(d: Spark) -> str:
    """Character errors of a second transcript against the lines that a person has settled: its text for a line is that of
    its own segments that the line's time touches, in order."""
    plain = lambda x: d.sub(d.sub(f"trim({d.sub(d.fold(x), '[^\\p{L}\\p{N}]+', ' ')})", " +", " "), "[^ -~]", "?")  # noqa: E731  engines count other letters as characters or as bytes
    gold = f"(SELECT id, recording_id, start_time, end_time, text FROM utterances WHERE {d.starts("coalesce(review_status, '')", "'user_'")})"
    return f"""WITH h AS (SELECT l.id, {d.join("r.text", " ", "r.start_time")} AS said FROM {overlaps(d, gold, "second_transcript", 60)} WHERE r.end_time > l.start_time AND r.start_time < l.end_time GROUP BY l.id),
        t AS (SELECT g.id, g.recording_id, {plain("g.text")} AS t, coalesce({plain("h.said")}, '') AS s FROM {gold} g LEFT JOIN h ON h.id = g.id)
        SELECT recording_id, cast(sum(levenshtein(t, s)) AS BIGINT) AS edits, cast(sum(length(t)) AS BIGINT) AS length_, round(sum(levenshtein(t, s)) * 1e0 / greatest(sum(length(t)), 1), 6) AS cer FROM t GROUP BY recording_id"""


_CLUSTERS = "c AS (SELECT vec_id, recording_id, gold, pred, before FROM clusterings)"


def pair_metrics(d: Spark, pred: str = "pred") -> str:
    """Pairs of different recordings: from counts of each cell, n (n - 1) / 2, less those within one recording."""
    pairs = lambda by: f"(SELECT coalesce(sum(k), 0) FROM (SELECT cast(count(*) AS DOUBLE) * (count(*) - 1) / 2 AS k FROM c GROUP BY {by} UNION ALL SELECT -cast(count(*) AS DOUBLE) * (count(*) - 1) / 2 FROM c GROUP BY {by}, recording_id) x)"
    return f"SELECT {pairs(f'gold, {pred}')} AS tp, {pairs(pred)} AS p, {pairs('gold')} AS g"


def pair_f1(d: Spark) -> str:
    return f"WITH {_CLUSTERS} SELECT tp, p - tp AS false_merge, g - tp AS false_split, round(tp / p, 6) AS precision_, round(tp / g, 6) AS recall_, round(2 * tp / (p + g), 6) AS f1 FROM ({pair_metrics(d)}) m"


def b_cubed(d: Spark) -> str:
    return f"WITH {_CLUSTERS}, w AS (SELECT count(*) OVER (PARTITION BY gold, pred) AS b, count(*) OVER (PARTITION BY pred) AS p, count(*) OVER (PARTITION BY gold) AS g FROM c) SELECT round(avg(b * 1.0 / p), 6) AS precision_, round(avg(b * 1.0 / g), 6) AS recall_ FROM w"


def regression_gate(d: Spark) -> str:
    """Whether a new clustering may take the place of the one before: no more false merges, and a higher F1 of pairs."""
    return f"WITH {_CLUSTERS} SELECT n.p - n.tp <= o.p - o.tp AND 2 * n.tp / (n.p + n.g) > 2 * o.tp / (o.p + o.g) AS passes, n.p - n.tp AS false_merge, o.p - o.tp AS before FROM ({pair_metrics(d)}) n CROSS JOIN ({pair_metrics(d, 'before')}) o"


def labelled_pairs(d: Spark, least: float = 0.6) -> str:
    """How a decision by cosine does on labelled pairs; those that are unsure don't count."""
    c = cosine(d, "a.embedding", "b.embedding")
    return f"""SELECT count(*) AS n, count(*) FILTER (WHERE same = (c >= {least})) AS right_, count(*) FILTER (WHERE NOT same AND c >= {least}) AS false_merge, count(*) FILTER (WHERE same AND c < {least}) AS false_split, round(count(*) FILTER (WHERE same = (c >= {least})) * 1e0 / greatest(count(*), 1), 6) AS accuracy
        FROM (SELECT p.verdict = 'same' AS same, round({c}, 9) AS c FROM gold_pairs p JOIN vectors a ON a.vec_id = p.a JOIN vectors b ON b.vec_id = p.b WHERE p.verdict <> 'unsure') t"""


def held_out(d: Spark) -> str:
    return "SELECT a, b, role FROM gold_pairs"


def recommendation(d: Spark) -> str:
    """How much there is to gain from reviewing a recording next. What is settled already has -1000; kinds of recordings of which none is
    settled gain."""
    per = lambda n: f"{n} * 1e0 / p.visible"
    kind = "CASE WHEN p.speakers <= 1 THEN 1 WHEN p.speakers >= 4 THEN 4 ELSE p.speakers END"
    return f"""WITH p AS (SELECT p.*, {kind.replace("p.", "")} AS kind, CASE WHEN microphone > 0 AND system_ > 0 THEN 'mixed' WHEN microphone > 0 THEN 'microphone' WHEN system_ > 0 THEN 'system' ELSE 'unknown' END AS track FROM ({profile(d)}) p),
        g AS (SELECT p.*, r.duration, r.speaker_review_status AS status, coalesce(s.score, 0) AS learning, coalesce(s.audio_exists, false) AS audio, coalesce(r.speaker_review_status, '') = 'gold' AND unassigned = 0 AND not_manual = 0 AND unreviewed = 0 AS gold FROM p JOIN recordings r ON r.id = p.recording_id LEFT JOIN review_signals s ON s.recording_id = r.id),
        have AS (SELECT kind, track FROM g WHERE gold)
        SELECT recording_id, round(CASE WHEN gold THEN -1000e0 ELSE learning + CASE WHEN audio THEN 35 ELSE -80 END + CASE status WHEN 'needs_correction' THEN 55 WHEN 'in_progress' THEN 45 WHEN 'complete' THEN 45 WHEN 'gold' THEN 20 ELSE 0 END
            + least(25e0, human_actions * 25e-1) + 20 * ({per("p.manual")}) + 12 * ({per("p.voices")}) + CASE WHEN p.speakers = 1 THEN 8 WHEN p.speakers = 2 THEN 24 WHEN p.speakers = 3 THEN 30 WHEN p.speakers > 3 THEN 26 ELSE 0 END
            + CASE WHEN NOT EXISTS (SELECT 1 FROM have h WHERE h.kind = p.kind) THEN 24 ELSE 0 END + CASE WHEN p.track <> 'unknown' AND NOT EXISTS (SELECT 1 FROM have h WHERE h.track = p.track) THEN 18 ELSE 0 END
            + CASE WHEN duration / 60 BETWEEN 1 AND 12 THEN 22 WHEN duration / 60 BETWEEN 12 AND 25 THEN 12 WHEN duration / 60 BETWEEN 25 AND 45 THEN 2 WHEN duration / 60 >= 45 THEN -least(30e0, (duration / 60 - 45) / 2) ELSE -15 END - CASE WHEN p.visible > 500 THEN 20 ELSE 0 END END, 6) AS score FROM g p"""


def leave_one_out(d: Spark) -> str:
    """Each identity's voice in a recording against the mean of its voices in its other recordings, where it has three or more.
    A voice of a recording is its vectors' sum, normalised."""
    x = d.unnest("(SELECT speaker_uuid, recording_id, embedding FROM vectors WHERE speaker_uuid IS NOT NULL) s", "embedding", "v", "k")
    return f"""WITH s AS (SELECT speaker_uuid, recording_id, cast(k AS BIGINT) AS k, sum(cast(v AS DOUBLE)) AS v FROM {x} GROUP BY speaker_uuid, recording_id, k), n AS (SELECT speaker_uuid, recording_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY speaker_uuid, recording_id),
        c AS (SELECT s.speaker_uuid, s.recording_id, s.k, s.v / n.norm AS v FROM s JOIN n ON n.speaker_uuid = s.speaker_uuid AND n.recording_id = s.recording_id WHERE n.norm > 0),
        a AS (SELECT speaker_uuid, k, sum(v) AS v, count(*) AS n FROM c GROUP BY speaker_uuid, k)
        SELECT c.speaker_uuid, c.recording_id, round(sum(c.v * (a.v - c.v)) / greatest(sqrt(sum(c.v * c.v)) * sqrt(sum((a.v - c.v) * (a.v - c.v))), 1e-9), 6) AS similarity, max(a.n) AS recordings FROM c JOIN a ON a.speaker_uuid = c.speaker_uuid AND a.k = c.k WHERE a.n >= 3 GROUP BY c.speaker_uuid, c.recording_id"""


def flags(d: Spark) -> str:
    return "SELECT u.id, count(e.vec_id) > 0 AS has_embedding FROM utterances u LEFT JOIN vectors e ON e.utterance_id = u.id GROUP BY u.id"


def missing_work(d: Spark, most: int = 100) -> str:
    """Lines without a vector, ``most`` of each recording, unless a job of the recording is under way."""
    return f"""SELECT id FROM (SELECT u.id, row_number() OVER (PARTITION BY u.recording_id ORDER BY u.utterance_index) AS n FROM utterances u WHERE NOT EXISTS (SELECT 1 FROM vectors e WHERE e.utterance_id = u.id)
        AND NOT EXISTS (SELECT 1 FROM {_QUEUE} q WHERE q.recording_id = u.recording_id AND q.status = 'processing' AND q.heartbeat IS NOT NULL AND q.id % 9 = 0)) t WHERE n <= {most}"""


_QUEUE = "(SELECT event_id AS id, user_id AS recording_id, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, event_id % 5 AS retries, cast(floor(value * 10) AS BIGINT) AS at_, CASE WHEN event_id % 4 <> 0 THEN cast(floor(value) AS BIGINT) END AS heartbeat FROM events)"


def queue_reconcile(d: Spark) -> str:
    """Jobs that still have work: their line exists, isn't blank and has no vector; those that were under way begin again."""
    jobs = "(SELECT event_id AS id, user_id * 1000 + event_id % 8 AS utterance_id, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'paused' ELSE 'completed' END AS status FROM events)"
    return f"""SELECT q.id, CASE WHEN q.status IN ('processing', 'paused') THEN 'pending' ELSE q.status END AS status FROM {jobs} q JOIN utterances u ON u.id = q.utterance_id
        WHERE trim(coalesce(CASE WHEN u.id % 10 = 3 THEN ' ' ELSE u.text END, '')) <> '' AND NOT EXISTS (SELECT 1 FROM vectors e WHERE e.utterance_id = u.id)"""


def backoff(d: Spark, now: int = 700) -> str:
    return f"SELECT q.id FROM {_QUEUE} q WHERE q.status = 'failed' AND q.retries < 3 AND {now} - q.at_ >= power(2, q.retries) * 60"


def stuck(d: Spark, now: int = 120) -> str:
    return f"SELECT q.id FROM {_QUEUE} q WHERE q.status = 'processing' AND (q.heartbeat IS NULL OR {now} - q.heartbeat > 60)"


def duplicate_jobs(d: Spark) -> str:
    return f"SELECT id, recording_id FROM (SELECT q.*, row_number() OVER (PARTITION BY recording_id ORDER BY id) AS n FROM {_QUEUE} q) t WHERE n = 1"


def job_state(d: Spark) -> str:
    return f"SELECT q.id, CASE WHEN q.status IN ('completed', 'done') THEN 'completed' WHEN q.retries < 3 THEN 'requeued' ELSE 'failed' END AS state FROM {_QUEUE} q"


def idempotent(d: Spark) -> str:
    """Inserts that repeat a key of their author: with the same intent they give the row that is there, else a conflict."""
    w = "OVER (PARTITION BY created_by, idempotency_key ORDER BY id"
    return f"""SELECT id, CASE WHEN n = 1 THEN 'inserted' WHEN recording_id = first_recording AND trim(body) = first_body THEN 'existing' ELSE 'conflict' END AS outcome, CASE WHEN n = 1 OR (recording_id = first_recording AND trim(body) = first_body) THEN first_id END AS row_id FROM (
        SELECT *, row_number() {w}) AS n, first_value(id) {w}) AS first_id, first_value(recording_id) {w}) AS first_recording, first_value(trim(body)) {w}) AS first_body FROM comment_inserts) t"""


def guarded_updates(d: Spark, slack: float = 0.002) -> str:
    """Edits that say which version they saw: refused if there is none, or it is another one by more than ``slack`` seconds."""
    return f"""SELECT id, seen IS NULL OR coalesce(abs(stored - seen) <= {slack}, false) AS accepted, CASE WHEN NOT (seen IS NULL OR coalesce(abs(stored - seen) <= {slack}, false)) THEN stored END AS current_version FROM note_edits"""


def recent(d: Spark, most: int = 64) -> str:
    """The last ``most`` results that are kept of each recording's jobs: what is older has been pushed out."""
    return f"SELECT id, recording_id FROM (SELECT q.*, row_number() OVER (PARTITION BY recording_id ORDER BY at_ DESC, id DESC) AS n FROM {_QUEUE} q WHERE status IN ('completed', 'done')) t WHERE n <= {most}"


def rolling(d: Spark, n: int = 4) -> str:
    return f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), 6) AS mean, count(*) OVER (PARTITION BY user_id, event_type) AS seen FROM events"


def activity_windows(d: Spark) -> str:
    """Hourly counts of events: the batch twin of the stream."""
    hour = "date_trunc('hour', ts)"
    return f"SELECT cast({hour} AS VARCHAR(19)) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


PLANS = {
    "AGG-01": speaker_stats, "AGG-02": by_source, "AGG-03": durations, "AGG-04": recordings_per_speaker, "AGG-05": speaker_recordings, "AGG-06": tag_counts, "AGG-07": link_counts, "AGG-08": best_tier, "AGG-09": owner_counts, "AGG-10": speaker_lists, "AGG-11": profile, "AGG-12": status, "AGG-13": daily, "AGG-14": relative_days, "AGG-15": talk_stats, "AGG-16": longest_monologue, "AGG-17": signature_words, "AGG-18": token_stats, "AGG-19": combine_stats, "AGG-20": language_vote, "AGG-21": union_duration, "AGG-22": dedup, "AGG-23": p95, "AGG-24": prototypes, "AGG-25": cohesion, "AGG-26": cluster_centroids, "AGG-27": detail, "AGG-28": embedding_coverage,
    "ASG-05": aliases,
    "EVL-02": error_rates, "EVL-06": pair_f1, "EVL-07": b_cubed, "EVL-08": regression_gate, "EVL-09": labelled_pairs, "EVL-10": held_out, "EVL-12": recommendation, "EVL-13": leave_one_out,
    "INF-02": coverage_scores, "INF-04": owner, "INF-05": verdicts, "INF-07": owner_likeness,
    "INT-01": overlap_evidence, "INT-02": exclusive_spans, "INT-03": clip, "INT-04": material_speakers, "INT-05": material_overlap,
    "REC-01": cohort_features,
    "STR-02": flags, "STR-03": missing_work, "STR-04": queue_reconcile, "STR-05": backoff, "STR-06": stuck, "STR-07": duplicate_jobs, "STR-09": job_state, "STR-11": activity_windows, "STR-12": recent, "STR-13": guarded_updates, "STR-14": idempotent, "STR-16": rolling,
    "TXT-01": canonical_text, "TXT-02": trimmed_words, "TXT-03": letter_words, "TXT-04": word_sets, "TXT-05": jaccard, "TXT-06": trigram_counts, "TXT-07": overlap_coefficient, "TXT-08": coverage, "TXT-09": ngram_evidence, "TXT-12": boilerplate, "TXT-13": symbols_only, "TXT-14": silence_filler, "TXT-15": script_outlier, "TXT-16": char_rate, "TXT-20": exemplar_sweep, "TXT-21": embedding_sweep, "TXT-22": mentions, "TXT-23": introductions, "TXT-24": safe_repair, "TXT-25": verdict_action, "TXT-26": mic_track, "TXT-27": same_person,
    "WIN-01": run_lengths, "WIN-02": previous_row, "WIN-03": speaker_change, "WIN-04": bridge_gaps, "WIN-08": adjacent_merge, "WIN-10": margins, "WIN-11": partition_interval, "WIN-12": anchor_union, "WIN-14": estimated_timing, "WIN-15": word_timing, "WIN-17": silence,
}
