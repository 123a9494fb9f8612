"""The library's relations, and how the driver's tables are read as such.

A deployment hands in its own tables under these names (:class:`Relations`); :func:`relations` derives them
from the synthetic tables, with values that exercise every rule.

utterances: id, recording_id, utterance_index, start_time, end_time, speaker, speaker_uuid, text, n_words, is_hidden,
review_status, suspicion, mean_p. recordings: id, title, file_name, file_path, external_id, duration, language,
created_at (epoch seconds), source, full_transcript, access. tags, recording_tags, meetings, recording_meetings, speakers,
attendee_mappings, attendees (of meetings), aliases (who stands for whom), tokens (a recogniser's, with their probabilities), review_signals, comments, turns (diarised intervals), words (timed words), vectors (voice vectors of utterances),
gold_pairs (labelled pairs of vectors), text_lines (lines of documents as a transcript), line_texts (their canonical texts, the seconds they take, their trigrams),
exemplars (short lines that recur).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .dialect import SPARK, Spark
from .storage import cut

EPOCH = 1704067200


#: What a refinement was made from: size, time and length of the file, and when it was transcribed (0 where unknown). Edits don't
#: change it; recordings r with their files f.
FINGERPRINT = " || ':' || ".join(f"cast(cast(floor(coalesce({x}, 0)) AS BIGINT) AS VARCHAR(20))" for x in ("f.size", "f.modified", "r.duration * 1000", "f.transcribed_at * 1000"))
LINE_DIGEST = "md5(cast(cast(round(start_time * 1000) AS BIGINT) AS VARCHAR(20)) || ':' || cast(cast(round(end_time * 1000) AS BIGINT) AS VARCHAR(20)) || ':' || coalesce(text, ''))"


def relations(d: Spark) -> dict[str, str]:
    """name -> SELECT over the driver's tables and the relations before it."""
    # Lines that a recogniser makes up in silence, among those of the documents.
    made = "CASE (doc_id * 100000 + place) % 97 WHEN 1 THEN 'Subtitles by the Amara.org community' WHEN 2 THEN line || ' www.example.com' WHEN 3 THEN line || ' Thanks for watching!' WHEN 4 THEN 'www.example.com' WHEN 5 THEN 'Спасибо за просмотр' WHEN 6 THEN '시청해 주셔서 감사합니다' ELSE line END"
    within = "substring(a.speaker_uuid, 5) = substring(b.speaker_uuid, 5) AND " if d.name == "spark" else ""
    lines = "split(text, '\\n')" if d.name == "spark" else "string_split(text, chr(10))"
    return {
        "utterances": f"""
            SELECT id, recording_id, utterance_index, speaker, speaker_uuid, text, n_words, is_hidden, review_status, suspicion, mean_p, speaker_assignment_source, speaker_reviewed_at, audio_source,
                   (sum(n_words) OVER (PARTITION BY recording_id ORDER BY utterance_index) - n_words) / 150e0 * 60 AS start_time,
                   sum(n_words) OVER (PARTITION BY recording_id ORDER BY utterance_index) / 150e0 * 60 AS end_time
            FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS recording_id, turn AS utterance_index, role AS speaker, text,
                         CASE WHEN role <> 'system' THEN 'spk-' || role || '-' || cast(conv_id % 7 AS VARCHAR(9)) END AS speaker_uuid,
                         cast({d.size(d.find("text", r"[^ \t\n\r]+"))} AS DOUBLE) AS n_words, (conv_id + turn) % 9 = 0 AS is_hidden,
                         CASE (conv_id + turn) % 5 WHEN 0 THEN 'user_kept' WHEN 1 THEN 'pending_review' END AS review_status,
                         cast((conv_id * 7 + turn * 3) % 11 AS DOUBLE) / 10 AS suspicion,
                         CASE WHEN (conv_id + 2 * turn) % 6 <> 0 THEN cast((conv_id * 3 + turn * 7) % 20 AS DOUBLE) / 20 END AS mean_p,
                         CASE WHEN conv_id % 8 = 0 THEN 'manual' WHEN (conv_id + turn) % 4 = 0 THEN 'global_manual' WHEN (conv_id + turn) % 4 = 1 THEN 'auto' END AS speaker_assignment_source,
                         CASE WHEN conv_id % 8 = 0 OR (conv_id + turn) % 3 <> 0 THEN {EPOCH} + turn END AS speaker_reviewed_at, CASE WHEN role = 'user' AND conv_id % 4 <> 1 THEN 'microphone' WHEN role = 'assistant' AND conv_id % 4 <> 2 THEN 'system' END AS audio_source
                  FROM (SELECT conv_id, turn, role, CASE WHEN turn = 1 AND conv_id % 6 = 2 THEN 'My name is ' || role || '. ' || text ELSE text END AS text FROM conversations) v) c""",
        # What a recogniser gives for each word of a line, after the marker that it begins with.
        "tokens": f"""
            SELECT recording_id, id AS utterance_id, '[_BEG_]' AS text, 1e-1 AS p FROM utterances UNION ALL
            SELECT recording_id, id, word, CASE WHEN (id + place) % 23 = 0 THEN NULL ELSE cast((id * 3 + place * 7) % 20 AS DOUBLE) / 20 END FROM {d.unnest(f"(SELECT id, recording_id, {d.find('text', r'[^ \t\n\r]+')} AS ws FROM utterances) t", "ws", "word", "place")}""",
        "review_signals": "SELECT recording_id, cast(recording_id * 13 % 60 AS DOUBLE) AS score, recording_id % 5 <> 2 AS audio_exists FROM (SELECT DISTINCT recording_id FROM utterances) u WHERE recording_id % 9 <> 4",
        # Recordings with lines, and imported files that nobody has transcribed.
        "recordings": f"""
            SELECT recording_id AS id, {d.cut("min_by(text, utterance_index)", "1", "40")} AS title, CASE WHEN recording_id % 6 = 1 THEN 'meeting_' || cast({EPOCH} + recording_id AS VARCHAR(20)) || '_mic.m4a' ELSE 'rec_' || cast(recording_id AS VARCHAR(20)) || '.m4a' END AS file_name,
                   '/audio/rec_' || cast(recording_id AS VARCHAR(20)) || '.m4a' AS file_path, 'ext' || cast(recording_id AS VARCHAR(20)) AS external_id, max(end_time) AS duration,
                   CASE recording_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS language,
                   {EPOCH} + recording_id * 18000 AS created_at, CASE recording_id % 3 WHEN 0 THEN 'recording' WHEN 1 THEN 'voiceMemos' ELSE 'imported' END AS source,
                   CASE WHEN recording_id % 10 <> 0 THEN min_by(text, utterance_index) END AS full_transcript, recording_id % 13 <> 0 AS access,
                   CASE WHEN recording_id % 8 = 0 OR recording_id % 5 = 3 THEN 'gold' WHEN recording_id % 5 = 0 THEN 'needs_correction' WHEN recording_id % 5 = 1 THEN 'in_progress' WHEN recording_id % 5 = 2 THEN 'complete' END AS speaker_review_status
            FROM utterances GROUP BY recording_id UNION ALL
            SELECT 1000000000 + item_id, {d.cut("text", "1", "40")}, 'import_' || cast(item_id % 25 AS VARCHAR(20)) || '.m4a', NULL, 'ext-i' || cast(item_id AS VARCHAR(20)), NULL, NULL,
                   {EPOCH} - item_id * 86400, 'imported', NULL, true, NULL FROM benchmark""",
        "tags": "SELECT id, 'tag' || cast(id AS VARCHAR(9)) AS name, id = 8 AS mcp_hidden FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS v(id)",
        "recording_tags": "SELECT DISTINCT id AS recording_id, id % 5 + 1 AS tag_id FROM recordings UNION SELECT id, 6 + id % 3 FROM recordings",
        "meetings": """
            SELECT id, 'cal-' || cast(id AS VARCHAR(20)) AS calendar_event_id, created_at + (id % 5 - 2) * 1000 AS start_at, created_at + (id % 5 - 2) * 1000 + CASE WHEN id % 10 = 3 THEN 86400 ELSE 600 END AS end_at, id % 4 = 0 AS is_recurring,
                   CASE WHEN id % 6 = 0 THEN 'Ada <ada@example.com>' END AS attendees,
                   CASE id % 5 WHEN 0 THEN 'Room 4' WHEN 1 THEN 'https://acme.zoom.us/j/' || cast(id AS VARCHAR(20)) WHEN 2 THEN 'join at teams.microsoft.com/l/' || cast(id AS VARCHAR(20)) END AS location,
                   CASE WHEN id % 8 = 0 THEN 'see https://Meet.Google.com/abc' END AS notes FROM recordings""",
        "recording_meetings": """
            SELECT r.id AS recording_id, m.id AS meeting_id, CASE WHEN r.id = m.id THEN 'matched' WHEN (r.id + m.id) % 2 = 0 THEN 'suggested' ELSE 'possible' END AS link_type,
                   1e0 / (1 + abs(r.id - m.id)) AS match_confidence, (r.id + m.id) % 7 = 0 AS is_dismissed
            FROM recordings r JOIN meetings m ON m.id = r.id UNION ALL
            SELECT r.id, m.id, CASE WHEN (r.id + m.id) % 2 = 0 THEN 'suggested' ELSE 'possible' END, 1e0 / 2, (r.id + m.id) % 7 = 0 FROM recordings r JOIN meetings m ON m.id = r.id + 1""",
        # A speaker of a meeting's recording is invited under an address, now and then with others who aren't heard.
        "attendees": """
            SELECT DISTINCT l.meeting_id, 'Person ' || u.speaker_uuid AS name, CASE WHEN length(u.speaker_uuid) % 2 = 0 THEN 'p.' || u.speaker_uuid || '@Example.com' END AS email FROM recording_meetings l JOIN utterances u ON u.recording_id = l.recording_id AND u.speaker_uuid IS NOT NULL WHERE NOT l.is_dismissed AND (l.meeting_id + length(u.speaker_uuid)) % 5 <> 0 UNION ALL
            SELECT id, 'Everyone', 'all@example.com' FROM meetings WHERE id % 4 = 2 UNION ALL SELECT id, '', NULL FROM meetings WHERE id % 7 = 0""",
        # Who stands for whom: chains, a circle of two, links of those who are no aliases any more.
        "aliases": "SELECT cast(id AS BIGINT) AS id, cast(CASE WHEN id % 12 = 5 THEN id + 1 WHEN id % 12 = 6 THEN id - 1 WHEN id % 4 <> 0 THEN id - 1 END AS BIGINT) AS canonical_id, CASE WHEN id % 11 = 3 THEN 'active' ELSE 'alias' END AS identity_state FROM recordings WHERE duration IS NOT NULL",
        "speakers": """
            SELECT speaker_uuid AS uuid, CASE WHEN length(speaker_uuid) % 2 = 0 OR min(recording_id) % 2 = 0 THEN upper(min(speaker)) || ' ' || cast(min(recording_id) AS VARCHAR(20)) END AS name,
                   CASE min(recording_id) % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'llm' END AS name_source, 'active' AS identity_state
            FROM utterances WHERE speaker_uuid IS NOT NULL GROUP BY speaker_uuid UNION ALL
            SELECT * FROM (VALUES ('spk-nobody', 'Nobody', 'llm', 'active'), ('spk-blank', cast(NULL AS VARCHAR(9)), cast(NULL AS VARCHAR(9)), cast(NULL AS VARCHAR(9))), ('spk-old', 'Old Name', NULL, 'active'),
                ('spk-typed', 'Typed In', 'manual', 'active'), ('spk-alias', 'Alias', 'llm', 'alias'), ('spk-invited', 'Invited', 'llm', 'active'), ('spk-empty', '', 'manual', 'active')) AS v(uuid, name, name_source, identity_state)""",
        "attendee_mappings": "SELECT * FROM (VALUES ('spk-invited', 'invited@example.com', 'manual'), ('spk-nobody', 'nobody@example.com', 'auto'), ('spk-user-1', 'user.one@example.com', 'manual'), ('spk-user-4', 'p.spk-user-4@example.com', 'manual')) AS v(speaker_uuid, email, source)",
        "comments": "SELECT id, recording_id, text AS body, CASE WHEN id % 3 = 0 THEN 'open' ELSE 'resolved' END AS status, speaker AS created_by, 'k' || cast(utterance_index AS VARCHAR(9)) AS idempotency_key FROM utterances",
        "turns": """
            SELECT event_id AS id, user_id AS recording_id, 'v' || cast(event_id % 6 AS VARCHAR(9)) AS speaker, floor(value * 3) + event_id % 40 AS start_time, floor(value * 3) + event_id % 40 + 1 + event_id % 7 AS end_time, event_id % 10 / 1e1 AS quality
            FROM events""",
        "words": """
            SELECT event_id AS id, user_id AS recording_id, event_type AS word, floor(value * 3) + event_id % 37 + 25e-2 AS start_time, floor(value * 3) + event_id % 37 + 75e-2 AS end_time
            FROM events""",
        # A voice is the first vector of its group; its other vectors lean on that one more or less. Two people of ten are each
        # taken for two speakers.
        "vectors": f"""
            SELECT e.vec_id, e.part AS library_id, e.vec_id % 10 + 10 * e.part AS recording_id, 'spk' || cast(e.label AS VARCHAR(9)) || '-' || cast(e.part AS VARCHAR(20)) AS speaker_uuid, e.label, cast(floor(e.vec_id / 5e0) AS BIGINT) * 1000 + e.vec_id % 5 AS utterance_id,
                   {d.blend("a.anchor", "e.embedding", "CASE e.vec_id % 4 WHEN 0 THEN 95e-2 WHEN 1 THEN 9e-1 WHEN 2 THEN 8e-1 ELSE 6e-1 END", "CASE e.vec_id % 4 WHEN 0 THEN 3e-1 WHEN 1 THEN 45e-2 WHEN 2 THEN 6e-1 ELSE 8e-1 END")} AS embedding,
                   cast(floor(e.vec_id / 1e1) % 25 AS DOUBLE) * 14e-1 AS start_time, cast(floor(e.vec_id / 1e1) % 25 AS DOUBLE) * 14e-1 + CASE WHEN e.vec_id % 7 = 0 THEN 35e-1 ELSE 15e-1 END AS end_time,
                   e.vec_id % 9 / 1e1 + 15e-2 AS quality, e.vec_id % 13 <> 0 AS reliable, CASE WHEN e.vec_id % 17 = 0 THEN 2e-1 ELSE 1e-2 END AS overlap_ratio, CASE WHEN e.vec_id % 19 = 0 THEN 2 ELSE 1 END AS active_speakers
            FROM (SELECT vec_id, label, embedding, cast(floor(vec_id / 25e1) AS BIGINT) AS part FROM embeddings) e
            JOIN (SELECT label, cast(floor(vec_id / 25e1) AS BIGINT) AS part, min_by(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1, 2) a ON a.label = CASE e.label WHEN 9 THEN 1 WHEN 8 THEN 2 ELSE e.label END AND a.part = e.part""",
        # Speakers that are equal end alike: so that Spark joins on the end as well, not on the place alone.
        "gold_pairs": f"""
            SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN (a.vec_id + b.vec_id) % 9 = 0 THEN 'unsure' WHEN a.speaker_uuid = b.speaker_uuid THEN 'same' ELSE 'different' END AS verdict,
                   CASE WHEN abs(a.recording_id) % 5 = 0 OR abs(b.recording_id) % 5 = 0 THEN 'heldOut' ELSE 'development' END AS role
            FROM (SELECT vec_id, recording_id, speaker_uuid, label, row_number() OVER (PARTITION BY speaker_uuid ORDER BY vec_id) AS n FROM vectors) a
            JOIN (SELECT vec_id, recording_id, speaker_uuid, label, row_number() OVER (PARTITION BY speaker_uuid ORDER BY vec_id) AS n FROM vectors) b
              ON a.n = b.n - 1 AND {within}(a.speaker_uuid = b.speaker_uuid OR (a.label + 1 = b.label AND substring(a.speaker_uuid, 5) = substring(b.speaker_uuid, 5)))""",
        "text_lines": f"""SELECT doc_id * 100000 + place AS id, doc_id AS recording_id, place AS utterance_index, lang, {made} AS text, 'v' || cast(place % 3 AS VARCHAR(9)) AS speaker, place * 15e0 AS start_time, place * 15e0 + 1 + (doc_id + place) % 14 AS end_time,
                   CASE WHEN (doc_id + place) % 6 <> 0 THEN cast((doc_id * 3 + place * 7) % 20 AS DOUBLE) / 20 END AS mean_p FROM {d.unnest(f"(SELECT doc_id, lang, {lines} AS xs FROM documents) t", "xs", "line", "place")}""",
        # What a process gave for each line: log lines, now and then an error.
        "process_runs": """
            SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS exit_code, 'main: loading model: x' || chr(10) || 'encoding audio slice' || chr(10) || chr(10) || CASE WHEN id % 5 = 0 THEN 'Error: bad audio' ELSE text END || chr(10) || '[debug] 12' || chr(10) || 'a=1 b: 2' AS stdout,
                   'model loaded in 12.50 ms' || chr(10) || 'Warning: slow disk' || chr(10) || 'generated ' || cast(utterance_index + 30 AS VARCHAR(9)) || ' tokens' || CASE WHEN id % 14 = 0 THEN chr(10) || 'malloc failed' ELSE '' END AS stderr FROM utterances""",
        # Lines by channel; some system lines come over the microphone as well, a second late.
        "channel_lines": """
            SELECT id, recording_id, start_time, end_time, text, speaker = 'user' AS mic FROM utterances UNION ALL
            SELECT -id - 1, recording_id, start_time + 1, end_time + 1, replace(replace(lower(text), ' de ', ' '), ' the ', ' '), true FROM utterances WHERE speaker = 'assistant' AND id % 5 = 0""",
        "old_turns": "SELECT id, recording_id, speaker, start_time, end_time FROM turns WHERE speaker IN ('v0', 'v1', 'v2')",
        "new_turns": "SELECT id, recording_id, 'n' || CASE WHEN id % 16 = 0 THEN 'x' ELSE substring(speaker, 2, 1) END AS speaker, start_time, end_time FROM turns WHERE speaker IN ('v0', 'v1') AND id % 5 <> 0",
        # The files of recordings, the lines they have now, and what a refinement in the background kept of them: some are of an older
        # schema, of a file or of lines that have changed since, or not complete.
        "audio_files": "SELECT id AS recording_id, id % 1000000 * 16000 + 44 AS size, created_at + 25e-2 AS modified, CASE WHEN id % 7 <> 0 THEN created_at + 36e2 END AS transcribed_at FROM recordings WHERE id % 11 <> 5",
        "line_digests": f"SELECT recording_id, md5({d.join(LINE_DIGEST, ',', 'utterance_index, id')}) AS digest FROM utterances GROUP BY recording_id",
        "refinements": f"""
            SELECT r.id AS recording_id, CASE WHEN r.id % 5 = 0 THEN 1 ELSE 2 END AS schema_version, {FINGERPRINT} || CASE WHEN r.id % 5 = 1 THEN '0' ELSE '' END AS fingerprint, CASE WHEN r.id % 5 = 4 THEN md5('') ELSE l.digest END AS digest,
                   CASE WHEN r.id % 3 <> 0 THEN r.created_at + 72e2 END AS completed_at, r.id % 2 = 0 AS has_checkpoint
            FROM recordings r LEFT JOIN audio_files f ON f.recording_id = r.id LEFT JOIN line_digests l ON l.recording_id = r.id WHERE r.id % 13 <> 4""",
        # What people have settled of the voices of recordings: who some are, and which are or aren't one.
        "voice_anchors": "SELECT DISTINCT library_id, recording_id, speaker_uuid, 'person-' || cast(label AS VARCHAR(9)) AS person FROM vectors WHERE label IN (1, 3) AND recording_id % 4 = 0",
        "voice_links": """
            SELECT DISTINCT a.library_id, a.recording_id, a.speaker_uuid, b.recording_id AS other_recording, b.speaker_uuid AS other, a.label = b.label AS same FROM (SELECT DISTINCT library_id, recording_id, speaker_uuid, label FROM vectors WHERE label IN (2, 5, 8)) a
            JOIN (SELECT DISTINCT library_id, recording_id, speaker_uuid, label FROM vectors WHERE label IN (2, 5, 8)) b ON b.library_id = a.library_id AND (a.label = 5 AND b.speaker_uuid = a.speaker_uuid AND b.recording_id = a.recording_id + 1 OR a.label = 2 AND b.label = 8)""",
        "voice_exemplars": "SELECT vec_id, library_id, embedding, 'thank you' || cast(vec_id AS VARCHAR(20)) AS text FROM vectors WHERE vec_id % 20 = 4",
        "repairs": "SELECT id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 1 THEN 'I cannot transcribe this' WHEN id % 7 = 2 THEN text || text || text || text WHEN id % 7 = 3 THEN '<|x|>' || text ELSE upper(text) END AS proposed FROM text_lines",
        "listener_verdicts": """
            SELECT id AS utterance_id, CASE WHEN suspicion >= 3e-1 THEN 'high' ELSE 'medium' END AS confidence, utterance_index = 6 AS clamped, CASE utterance_index % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'not_spoken' ELSE 'wrong' END AS verdict,
                   CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' {x}' WHEN 2 THEN text || text || text || text ELSE reverse(text) END AS heard FROM utterances""",
        "people": "SELECT uuid, CASE WHEN length(uuid) % 3 = 0 THEN lower(replace(name, ' ', '.')) || '@example.com' ELSE name END AS called FROM speakers",
        "heard_languages": "SELECT u.recording_id, CASE WHEN u.suspicion >= 9e-1 THEN 'auto' WHEN u.id % 4 = 0 THEN 'en' ELSE r.language END AS language, u.mean_p AS confidence, u.start_time, u.end_time FROM utterances u JOIN recordings r ON r.id = u.recording_id",
        "mixed_voices": "SELECT DISTINCT recording_id, speaker_uuid FROM vectors WHERE recording_id % 11 = 3 AND label = 3",
        "heard_lines": "SELECT id, recording_id, utterance_index, start_time, end_time, CASE WHEN id % 17 = 0 THEN 2 ELSE 1 END AS active, CASE WHEN suspicion > 0.3 THEN speaker END AS speaker FROM utterances",
        # Texts that were put together from a line, or from it and the two after it.
        "line_supports": "SELECT id, id AS anchor FROM utterances WHERE id % 3 < 2 UNION ALL SELECT id, id + 1 FROM utterances WHERE id % 3 = 1 UNION ALL SELECT id, id + 2 FROM utterances WHERE id % 3 = 1",
        # A recogniser that hears every e as an a and has its times a second late.
        "second_transcript": "SELECT id, recording_id, start_time + 1 AS start_time, end_time + 1 AS end_time, replace(text, 'e', 'a') AS text FROM utterances",
        "clusterings": "SELECT vec_id, recording_id, label AS gold, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS pred, (label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS before FROM vectors",
        "guesses": """
            SELECT uuid, name, length(uuid) % 3 AS tier, 5e-1 + length(uuid) % 5 / 1e1 AS score, CASE WHEN name_source = 'manual' THEN lower(name) WHEN name_source = 'llm' THEN 'Someone Else' END AS heard, CASE WHEN length(name) % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence
            FROM speakers WHERE coalesce(name, '') <> ''""",
        "comment_inserts": """
            SELECT id, recording_id, body, created_by, idempotency_key || '-' || cast(recording_id % 9 AS VARCHAR(9)) AS idempotency_key FROM comments UNION ALL
            SELECT id + 500000000, recording_id, body || ' ', created_by, idempotency_key || '-' || cast(recording_id % 9 AS VARCHAR(9)) FROM comments WHERE id % 4 = 0""",
        "note_edits": "SELECT id, CASE WHEN id % 6 <> 0 THEN created_at * 1e0 END AS stored, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN created_at + 1e-3 WHEN 2 THEN created_at + 5e-1 ELSE created_at * 1e0 END AS seen FROM recordings",
        # Voices under the speaker that they were given to: one in eleven under another's.
        "said_by": "SELECT vec_id, recording_id, embedding, CASE WHEN vec_id % 11 = 0 THEN 'spk' || cast((label + 1) % 10 AS VARCHAR(9)) || '-' || cast(library_id AS VARCHAR(20)) ELSE speaker_uuid END AS own FROM vectors",
        "line_texts": f"SELECT id, recording_id, s, t, {d.grams('t', 3)} AS gs FROM (SELECT id, recording_id, end_time - start_time AS s, {d.canonical('text')} AS t FROM text_lines) q WHERE t <> ''",
        "exemplars": f"SELECT min(id) AS id, t AS text, count(*) AS occurrences FROM line_texts WHERE {d.size(d.find('t', '[^ ]+'))} <= 8 GROUP BY t HAVING count(*) >= 3",
    }


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Relations that statements read several times and that are costly to derive: written once for each statement. Those that are larger
#: than the tables, as the trigrams of lines, aren't.
STORED = ("exemplars",)


def reads(sql: str, name: str) -> bool:
    """Whether a statement has the relation or table in a FROM or JOIN."""
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def used(d: Spark, sql: str, given: frozenset[str] = frozenset()) -> dict[str, str]:
    """The relations that ``sql`` reads, each after those that it reads itself; not those that are ``given`` as tables."""
    all_ = {k: v for k, v in relations(d).items() if k not in given}
    out: dict[str, str] = {}

    def need(text: str) -> None:
        for name in all_:
            if name not in out and reads(text, name):
                need(all_[name])
                out.setdefault(name, all_[name])

    need(sql)
    return out


class Relations:
    """The relations of one library, under view names of its own: two libraries in a session don't see each other's.

    ``source``: a folder of the driver's tables, over which the relations are derived, or a deployment's own relations by
    name. A relation is registered when a statement first reads it.
    """

    def __init__(self, spark: SparkSession, source: str | dict[str, DataFrame]):
        self.spark, self.source, self._prefix = spark, source, f"r{uuid.uuid4().hex[:12]}"
        self._views: dict[str, str] = {}
        if isinstance(source, dict):
            for name, df in source.items():
                self.put(name, df)

    def put(self, name: str, df: DataFrame) -> None:
        """``df`` as the relation of that name, from now on."""
        own = f"{self._prefix}_{name}"
        df.createOrReplaceTempView(own)
        self._views[name] = own

    def _need(self, sql: str) -> None:
        if isinstance(self.source, dict):
            if "line_texts" not in self._views and "text_lines" in self._views and (reads(sql, "line_texts") or reads(sql, "exemplars")):
                self.put("line_texts", self.spark.sql(self._own(relations(SPARK)["line_texts"])))
            if "exemplars" not in self._views and "line_texts" in self._views and reads(sql, "exemplars"):
                self.put("exemplars", cut(self.spark.sql(self._own(relations(SPARK)["exemplars"])), "exemplars"))
            return
        named = used(SPARK, sql)
        text = " ".join([sql, *named.values()])
        for t in TABLES:
            if t not in self._views and reads(text, t):
                self.put(t, dealt(self.spark.read.parquet(f"{self.source}/{t}.parquet")))
        for name, body in named.items():
            if name not in self._views:
                derived = self.spark.sql(self._own(body))
                self.put(name, cut(derived, name) if name in STORED else derived)

    def _own(self, sql: str) -> str:
        """``sql`` with this library's views after FROM and JOIN."""
        if not self._views:
            return sql
        return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(map(re.escape, self._views))})\b", lambda m: f"{m[1]}{m[2]}{self._views[m[3]]}", sql)

    def sql(self, sql: str) -> DataFrame:
        self._need(sql)
        return self.spark.sql(self._own(sql))

    def table(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def drop(self) -> None:
        """Take the views away. What was made of them stays."""
        for own in self._views.values():
            self.spark.catalog.dropTempView(own)
        self._views = {}


def statement(spark: SparkSession, source: str | dict[str, DataFrame], sql: str) -> DataFrame:
    """``sql`` over the relations of a source."""
    of = Relations(spark, source)
    try:
        return of.sql(sql)
    finally:
        of.drop()


def dealt(df: DataFrame) -> DataFrame:
    """A table that comes in fewer parts than there are cores (one small file), dealt to all of them; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_relations(d: Spark, sql: str) -> str:
    """``sql`` as one statement, with the relations that it uses as common table expressions."""
    ctes = ", ".join(f"{n} AS ({body})" for n, body in used(d, sql).items())
    if not ctes:
        return sql
    rest = sql.strip()
    if rest[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    return f"WITH {ctes}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {ctes} {rest}"
