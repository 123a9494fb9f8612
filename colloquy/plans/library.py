"""Scans, sinks, filters and joins over a library of conversations.

Each plan is a function of a dialect that returns one SELECT over the relations of :mod:`colloquy.domain`. Parameters
have defaults, so that a plan's name alone runs it; ``plan(..., **values)`` overrides them.
"""

from __future__ import annotations

from ..dialect import Spark
from ..domain import FINGERPRINT

WORD = r"[^ \t\n\r]+"


# --- scans and lookups ----------------------------------------------------------------------------------------------


def newest(d: Spark, limit: int = 100) -> str:
    return f"SELECT id, title, created_at FROM recordings ORDER BY created_at DESC, id DESC LIMIT {limit}"


def lookup(d: Spark, by: str = "file_name", value: str | int = "rec_7.m4a") -> str:
    """One recording by a key: id, file_name, file_path or external_id."""
    if by not in ("id", "file_name", "file_path", "external_id"):
        raise ValueError(f"no such key: {by}")
    return f"SELECT id, file_name, file_path, external_id FROM recordings WHERE {by} = {int(value) if by == 'id' else d.text(str(value))}"


def lookups(d: Spark, id: int = 3, file_name: str = "rec_7.m4a", file_path: str = "/audio/rec_12.m4a", external_id: str = "ext9") -> str:
    """All four key lookups, each a filter of its own."""
    asked = {"id": id, "file_name": file_name, "file_path": file_path, "external_id": external_id}
    return " UNION ALL ".join(f"SELECT {d.text(by)} AS found_by, x.* FROM ({lookup(d, by, value)}) x" for by, value in asked.items())


def prefix(d: Spark, start: str = "rec_1") -> str:
    """File names that begin with ``start``, whatever characters it has; oldest first."""
    return f"SELECT id, file_name, created_at FROM recordings WHERE {d.starts('file_name', d.text(start))} ORDER BY created_at, id"


def in_range(d: Spark, first: int = 1704067200, last: int = 1704867200) -> str:
    return f"SELECT id, created_at FROM recordings WHERE created_at BETWEEN {first} AND {last}"


def children(d: Spark, recording: int = 4, include_hidden: bool = False) -> str:
    hidden = "" if include_hidden else " AND NOT is_hidden"
    return f"SELECT id, utterance_index, text FROM utterances WHERE recording_id = {recording}{hidden}"


def tables(d: Spark) -> str:
    return "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings"


# What marks a line of a process's output as a log line, and its errors.
LOG_LINES = (
    "main: loading model:", "llama_model_loader:", "llama_new_context", "llama_kv_cache", "encoding audio slice", "audio slice encoded", "decoding audio batch", "audio decoded", "audio_slices:", "ggml_", "llama_", "system_info:", "sampling:",
    "compute_buffer_size:", "available_memory:", "sample time", "prompt eval time", "eval time", "total time", "processing", "loading", "initializing",
)


PROCESS_ERRORS = (
    ("file_not_found", ("Unable to open file", "No such file or directory")), ("model_error", ("failed to load model", "ggml_graph_compute")), ("memory_error", ("out of memory", "malloc failed")), ("audio_format_error", ("unsupported audio format", "invalid audio")),
)


def process_output(d: Spark) -> str:
    """A process's stdout, stderr and exit code -> error or transcript, warnings and timings.

    The transcript is what follows the last empty line, or all of it, without log lines; under three characters it is
    none.
    """
    nl = "chr(10)"
    lines = lambda x: f"split({x}, '\\n')" if d.name == "spark" else f"string_split({x}, {nl})"
    last = f"substring_index(stdout, {nl} || {nl}, -1)" if d.name == "spark" else f"string_split(stdout, {nl} || {nl})[-1]"
    joined = lambda x: f"array_join({x}, {nl})" if d.name == "spark" else f"array_to_string({x}, {nl})"
    logs = " OR ".join(f"contains(lower(x), {d.text(m)})" for m in LOG_LINES)
    odd = " OR ".join([*(d.starts("trim(x)", d.text(s)) for s in ("[", "{", "//", "#")), "(contains(x, '=') AND contains(x, ':'))", *(f"contains(x, {d.text(s)})" for s in (" ms", " tokens/s", " MB"))])
    error = " ".join(f"WHEN {' OR '.join(f'contains(stderr, {d.text(m)})' for m in marks)} THEN {d.text(kind)}" for kind, marks in PROCESS_ERRORS)
    number = lambda p: f"cast(nullif({d.group('stderr', p, 1)}, '') AS DOUBLE)"
    return f"""WITH t AS (SELECT *, CASE WHEN exit_code <> 0 THEN CASE {error} ELSE 'unknown' END WHEN contains(stdout, 'Error:') OR contains(stdout, 'ERROR') THEN 'unknown' END AS error, {last} AS rest FROM process_runs),
        k AS (SELECT *, trim({joined(d.kept(lines("CASE WHEN rest = '' THEN stdout ELSE rest END"), "x", f"NOT (trim(x) = '' OR {logs} OR {odd})"))}) AS said FROM t)
        SELECT id, CASE WHEN error IS NULL AND length(said) < 3 THEN 'unknown' ELSE error END AS error, CASE WHEN error IS NULL AND length(said) >= 3 THEN said END AS transcript,
            {d.size(d.kept(lines("stderr"), "x", "contains(x, 'warning:') OR contains(x, 'Warning:')"))} AS warnings, {number("model loaded in ([0-9]+[.][0-9]+) ms")} / 1e3 AS load_seconds, {number("generated ([0-9]+) tokens")} AS tokens FROM k"""


# --- sinks ----------------------------------------------------------------------------------------------------------


CSV_HEADER = "File Name,Date,Duration,Language,Status,Error,Transcript"


def csv_rows(d: Spark) -> str:
    """The lines of a CSV export: all fields quoted, quotes in the transcript doubled, its line breaks spaces; header first."""
    field = lambda x: f"'\"' || coalesce(cast({x} AS VARCHAR(40)), '') || '\"'"
    text = f"replace(replace(coalesce(full_transcript, ''), '\"', '\"\"'), chr(10), ' ')"
    return f"""SELECT -1 AS id, {d.text(CSV_HEADER)} AS line UNION ALL SELECT id, {" || ',' || ".join([field("file_name"), field("created_at"), field("cast(floor(duration) AS BIGINT)"), field("language")])} || ',"' || CASE WHEN full_transcript IS NULL THEN 'Pending' ELSE 'Completed' END || '","","' || {text} || '"' FROM recordings"""


def plain_text(d: Spark) -> str:
    return f"SELECT recording_id, {d.join("speaker || ': ' || text", chr(10) if d.name == 'duckdb' else chr(92) + 'n', 'utterance_index')} AS transcript FROM utterances WHERE NOT is_hidden GROUP BY recording_id"


def markdown(d: Spark) -> str:
    """A header where the speaker changes."""
    nl = "chr(10)"
    return f"""SELECT id, CASE WHEN before IS NULL OR before <> speaker THEN '## ' || speaker || {nl} ELSE '' END || text AS line
        FROM (SELECT id, speaker, text, lag(speaker) OVER (PARTITION BY recording_id ORDER BY utterance_index) AS before FROM utterances WHERE NOT is_hidden) t"""


def _stamp(seconds: str, mark: str) -> str:
    ms = f"cast(floor(greatest({seconds}, 0) * 1000 + 0.000001) AS BIGINT)"
    part = lambda of, per, wide: f"lpad(cast(cast(floor({ms} / {of}) AS BIGINT) % {per} AS VARCHAR(9)), {wide}, '0')"
    return f"{part(3600000, 1000, 2)} || ':' || {part(60000, 60, 2)} || ':' || {part(1000, 60, 2)} || '{mark}' || {part(1, 1000, 3)}"


def subtitles(d: Spark, mark: str = ",") -> str:
    """Numbered cues; milliseconds are cut off, not rounded. ``mark``: comma for SRT, dot for WebVTT."""
    return f"""SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_index) AS cue, {_stamp("start_time", mark)} || ' --> ' || {_stamp("end_time", mark)} AS span, text
        FROM utterances WHERE NOT is_hidden"""


def shown_name(d: Spark) -> str:
    """A speaker's name, or "Speaker " and the beginning of its key, or the local label."""
    return f"coalesce(nullif(s.name, ''), 'Speaker ' || {d.cut('u.speaker_uuid', '1', '8')}, u.speaker)"


def labelled(d: Spark) -> str:
    blank = "\\n\\n" if d.name == "spark" else None
    text = f"'[' || {shown_name(d)} || '] ' || u.text"
    made = d.join(text, blank, "utterance_index") if blank else f"string_agg({text}, chr(10) || chr(10) ORDER BY utterance_index)"
    return f"SELECT u.recording_id, {made} AS transcript FROM utterances u LEFT JOIN speakers s ON s.uuid = u.speaker_uuid WHERE NOT u.is_hidden GROUP BY u.recording_id"


def full_transcript(d: Spark) -> str:
    return f"SELECT recording_id, {d.join('trim(text)', ' ', 'utterance_index')} AS transcript FROM utterances WHERE NOT is_hidden AND trim(text) <> '' GROUP BY recording_id"


def upsert(d: Spark) -> str:
    """New links replace old ones of the same pair: the latest version wins."""
    return """SELECT recording_id, meeting_id, link_type, version FROM (
          SELECT *, row_number() OVER (PARTITION BY recording_id, meeting_id ORDER BY version DESC) AS n FROM (
            SELECT recording_id, meeting_id, link_type, 1 AS version FROM recording_meetings UNION ALL
            SELECT recording_id, meeting_id, 'confirmed', 2 FROM recording_meetings WHERE recording_id % 4 = 0) v) w WHERE n = 1"""


def replace_part(d: Spark, recording: int = 5) -> str:
    """A new transcription takes the place of one recording's lines and leaves the others."""
    return f"SELECT id, recording_id, text FROM utterances WHERE recording_id <> {recording} UNION ALL SELECT id, recording_id, upper(text) FROM utterances WHERE recording_id = {recording} AND NOT is_hidden"


def fingerprint(d: Spark, version: int = 2) -> str:
    """What each recording's refinement is made from, and what becomes of the one that is kept: ``completed`` and ``resumable`` ones are
    of this schema version, of the same file and transcription and of the lines as they are now; else a recording is ``due``."""
    return f"""SELECT r.id, {FINGERPRINT} AS fingerprint, CASE WHEN a.schema_version = {version} AND a.fingerprint = {FINGERPRINT} AND coalesce(a.digest, '') = coalesce(l.digest, '') AND (a.completed_at IS NOT NULL OR a.has_checkpoint)
            THEN CASE WHEN a.completed_at IS NOT NULL THEN 'completed' ELSE 'resumable' END ELSE 'due' END AS state
        FROM recordings r LEFT JOIN audio_files f ON f.recording_id = r.id LEFT JOIN line_digests l ON l.recording_id = r.id LEFT JOIN refinements a ON a.recording_id = r.id"""


def backfill_keys(d: Spark) -> str:
    """One surrogate for each distinct label without a key, on all of its rows."""
    return "SELECT u.id, coalesce(u.speaker_uuid, k.made) AS speaker_uuid FROM utterances u LEFT JOIN (SELECT DISTINCT speaker, md5(speaker) AS made FROM utterances WHERE speaker_uuid IS NULL) k ON k.speaker = u.speaker"


# --- filters --------------------------------------------------------------------------------------------------------

VISIBLE = "r.access AND NOT EXISTS (SELECT 1 FROM recording_tags x JOIN tags t ON t.id = x.tag_id WHERE x.recording_id = r.id AND t.mcp_hidden)"


def browse(d: Spark, tags: tuple = (1, 2, 7), speaker: str = "user", first: int = 1704067200, last: int | None = None, source: str = "recording", text: str = "th", limit: int = 200) -> str:
    """``text`` may hold wildcards."""
    like = d.text(f"%{text}%")
    return f"""SELECT r.id, r.title, r.created_at FROM recordings r
        WHERE EXISTS (SELECT 1 FROM recording_tags x WHERE x.recording_id = r.id AND x.tag_id IN ({", ".join(str(int(t)) for t in tags)}))
          AND EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND u.speaker = {d.text(speaker)})
          AND r.created_at >= {int(first)}{"" if last is None else f" AND r.created_at <= {int(last)}"} AND r.source = {d.text(source)} AND (r.title ILIKE {like} OR r.full_transcript ILIKE {like})
        ORDER BY r.created_at DESC, r.id DESC LIMIT {int(limit)}"""


def recording_filter(
    d: Spark, tags: tuple = (), all_tags: bool = False, speakers: tuple = (), sources: tuple = (), events: tuple = (), has_transcript: bool | None = None, has_open_comments: bool | None = None, text: str | None = None, within_lines: bool = True,
    first: int | None = None, last: int | None = None, before: tuple[int, int] | None = None,
) -> str:
    """A condition on ``recordings r``: every filter that is given, all of them at once. Any user's text is a literal."""
    out = []
    if tags:
        rows = f"SELECT DISTINCT t.id, lower(a.name) AS name FROM (VALUES {', '.join(f'({d.text(t.lower())})' for t in tags)}) AS a(name) JOIN tags t ON lower(t.name) = a.name OR cast(t.id AS VARCHAR(20)) = a.name"
        if all_tags:
            out.append(f"r.id IN (SELECT x.recording_id FROM recording_tags x JOIN ({rows}) f ON f.id = x.tag_id GROUP BY x.recording_id HAVING count(DISTINCT x.tag_id) = {len({t.lower() for t in tags})})")
        else:
            out.append(f"r.id IN (SELECT x.recording_id FROM recording_tags x JOIN ({rows}) f ON f.id = x.tag_id)")
    if speakers:
        out.append(f"EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND NOT u.is_hidden AND u.speaker_uuid IN ({d.texts(speakers)}))")
    if sources:
        out.append(f"r.source IN ({d.texts(sources)})")
    if events:
        out.append(f"EXISTS (SELECT 1 FROM recording_meetings l JOIN meetings m ON m.id = l.meeting_id WHERE l.recording_id = r.id AND NOT l.is_dismissed AND m.calendar_event_id IN ({d.texts(events)}))")
    if has_transcript is not None:
        out.append(f"{'' if has_transcript else 'NOT '}EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND NOT u.is_hidden)")
    if has_open_comments is not None:
        out.append(f"{'' if has_open_comments else 'NOT '}EXISTS (SELECT 1 FROM comments c WHERE c.recording_id = r.id AND c.status = 'open')")
    if text is not None:
        t = d.text(text.lower())
        inside = f" OR EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND NOT u.is_hidden AND contains(lower(u.text), {t}))" if within_lines else ""
        out.append(f"(contains(lower(r.title), {t}){inside})")
    if first is not None:
        out.append(f"r.created_at >= {int(first)}")
    if last is not None:
        out.append(f"r.created_at <= {int(last)}")
    if before is not None:
        out.append(f"(r.created_at < {int(before[0])} OR (r.created_at = {int(before[0])} AND r.id < {int(before[1])}))")
    return " AND ".join(out) or "true"


def library_filter(d: Spark, tags: tuple = ("tag1", "tag7"), sources: tuple = ("recording", "imported"), text: str = "th", **more) -> str:
    return f"SELECT r.id, r.title FROM recordings r WHERE {VISIBLE} AND {recording_filter(d, tags=tags, sources=sources, text=text, **more)}"


def all_tags(d: Spark, tags: tuple = ("tag2", "tag7")) -> str:
    """Tokens resolve to tags first; one that resolves to none matches nothing."""
    rows = ", ".join(f"('{t}')" for t in tags)
    return f"""WITH asked AS (SELECT name FROM (VALUES {rows}) AS v(name)),
        found AS (SELECT DISTINCT t.id FROM asked a JOIN tags t ON lower(t.name) = lower(a.name)),
        known AS (SELECT (SELECT count(*) FROM asked a WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE lower(t.name) = lower(a.name))) AS missing, (SELECT count(*) FROM found) AS wanted)
        SELECT x.recording_id AS id FROM recording_tags x JOIN found f ON f.id = x.tag_id CROSS JOIN known k WHERE k.missing = 0 GROUP BY x.recording_id, k.wanted HAVING count(DISTINCT x.tag_id) = k.wanted"""


def has_speaker(d: Spark, speakers: tuple = ("spk-user-1", "spk-assistant-3")) -> str:
    return f"SELECT r.id FROM recordings r WHERE EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND NOT u.is_hidden AND u.speaker_uuid IN ({', '.join(repr(s) for s in speakers)}))"


def source_in(d: Spark, sources: tuple = ("imported", "voiceMemos")) -> str:
    return f"SELECT id, source FROM recordings WHERE source IN ({', '.join(repr(s) for s in sources)})"


def linked_meeting(d: Spark, events: tuple = ("cal-3", "cal-4", "cal-5", "cal-9")) -> str:
    return f"""SELECT r.id FROM recordings r WHERE EXISTS (SELECT 1 FROM recording_meetings l JOIN meetings m ON m.id = l.meeting_id
        WHERE l.recording_id = r.id AND NOT l.is_dismissed AND m.calendar_event_id IN ({", ".join(repr(e) for e in events)}))"""


def has_parts(d: Spark, has_transcript: bool | None = True, has_open_comments: bool | None = False) -> str:
    return f"SELECT r.id FROM recordings r WHERE {recording_filter(d, has_transcript=has_transcript, has_open_comments=has_open_comments)}"


def text_contains(d: Spark, text: str = "the") -> str:
    """``text`` is plain: wildcards in it stand for themselves."""
    t = text.lower().replace("'", "''")
    return f"SELECT r.id FROM recordings r WHERE contains(lower(r.title), '{t}') OR EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id AND contains(lower(u.text), '{t}'))"


def keyset_page(d: Spark, created_at: int = 1704967200, id: int = 50, limit: int = 20) -> str:
    cursor = "cast(created_at AS VARCHAR(20)) || '|' || cast(id AS VARCHAR(20))"
    encoded = f"base64(cast({cursor} AS BINARY))" if d.name == "spark" else f"base64(encode({cursor}))"
    return f"SELECT id, created_at, {encoded} AS next FROM recordings WHERE created_at < {created_at} OR (created_at = {created_at} AND id < {id}) ORDER BY created_at DESC, id DESC LIMIT {limit}"


def private(d: Spark) -> str:
    return f"SELECT r.id FROM recordings r WHERE {VISIBLE}"


def private_meetings(d: Spark) -> str:
    """A meeting is hidden as soon as one active link leads to a hidden recording."""
    return f"""WITH seen AS (SELECT r.id FROM recordings r WHERE {VISIBLE})
        SELECT m.id FROM meetings m WHERE NOT EXISTS (SELECT 1 FROM recording_meetings l LEFT JOIN seen s ON s.id = l.recording_id WHERE l.meeting_id = m.id AND NOT l.is_dismissed AND s.id IS NULL)"""


LINES = "(SELECT * FROM utterances WHERE NOT is_hidden)"


def visible(d: Spark) -> str:
    """The visible lines: what every reader of transcripts starts from."""
    return f"SELECT id, recording_id, utterance_index FROM {LINES} u"


def unsettled(d: Spark) -> str:
    """Rows that a person has decided are left alone."""
    return "SELECT id, review_status FROM utterances WHERE review_status IS NULL OR NOT review_status LIKE 'user\\_%' ESCAPE '\\'" if d.name == "duckdb" else "SELECT id, review_status FROM utterances WHERE NOT coalesce(startswith(review_status, 'user_'), false)"


def substring(d: Spark, text: str = "an", limit: int | None = None) -> str:
    """``text`` may hold wildcards; in order of recording and place."""
    return f"SELECT id, recording_id, utterance_index FROM utterances WHERE text ILIKE {d.text(f'%{text}%')} AND NOT is_hidden ORDER BY recording_id, utterance_index{'' if limit is None else f' LIMIT {int(limit)}'}"


# Hosts of calls.
CALL_HOSTS = ("zoom.us", "meet.google.com", "teams.microsoft.com", "webex.com")


def qualified_meetings(d: Spark) -> str:
    """Real meetings: shorter than a day, with attendees or a call's address in the place or the notes; and that address."""
    call = "(?i)([^ \\n\\t]*(?:" + "|".join(h.replace(".", "[.]") for h in CALL_HOSTS) + ")[^ \\n\\t]*)"
    link = f"coalesce(nullif({d.group('location', call, 1)}, ''), nullif({d.group('notes', call, 1)}, ''))"
    return f"""SELECT id, CASE WHEN {d.starts("lower(link)", "'http'")} THEN link ELSE 'https://' || link END AS join_url FROM (SELECT id, attendees, {link} AS link FROM meetings WHERE end_at - start_at > 0 AND end_at - start_at < 86400) m
        WHERE coalesce(attendees, '') <> '' OR link IS NOT NULL"""


def upcoming(d: Spark, now: int = 1704122140, lead: int = 120, prompted: tuple = ("cal-9",)) -> str:
    """Meetings that begin within ``lead`` seconds and haven't been announced."""
    return f"SELECT id, start_at - {int(now)} AS seconds FROM meetings WHERE start_at - {int(now)} > 0 AND start_at - {int(now)} <= {int(lead)} AND calendar_event_id NOT IN ({d.texts(prompted or ('',))})"


# --- joins ----------------------------------------------------------------------------------------------------------


def with_recording(d: Spark) -> str:
    return "SELECT u.id, r.title, r.created_at FROM utterances u JOIN recordings r ON r.id = u.recording_id"


def display_name(d: Spark) -> str:
    return f"SELECT u.id, {shown_name(d)} AS speaker_name FROM utterances u LEFT JOIN speakers s ON s.uuid = u.speaker_uuid"


def bridges(d: Spark) -> str:
    return "SELECT r.id, t.name AS tag, m.calendar_event_id FROM recordings r JOIN recording_tags x ON x.recording_id = r.id JOIN tags t ON t.id = x.tag_id JOIN recording_meetings l ON l.recording_id = r.id JOIN meetings m ON m.id = l.meeting_id WHERE NOT l.is_dismissed"


def co_appearance(d: Spark) -> str:
    return """WITH present AS (SELECT DISTINCT recording_id, speaker_uuid FROM utterances WHERE speaker_uuid IS NOT NULL)
        SELECT a.speaker_uuid AS speaker, b.speaker_uuid AS other, count(DISTINCT a.recording_id) AS recordings FROM present a JOIN present b ON a.recording_id = b.recording_id AND a.speaker_uuid <> b.speaker_uuid GROUP BY a.speaker_uuid, b.speaker_uuid"""


def talk_slice(d: Spark, speaker: str = "spk-user-2") -> str:
    return f"SELECT u.id, u.text FROM utterances u WHERE NOT u.is_hidden AND u.recording_id IN (SELECT recording_id FROM utterances WHERE speaker_uuid = '{speaker}')"


def untranscribed(d: Spark) -> str:
    """Recordings without any line, newest first."""
    return "SELECT r.id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM utterances u WHERE u.recording_id = r.id) ORDER BY r.created_at DESC, r.id DESC"


def orphans(d: Spark) -> str:
    """Speakers of no line, without those that a person has named or mapped and without aliases."""
    return """SELECT s.uuid FROM speakers s WHERE NOT EXISTS (SELECT 1 FROM utterances u WHERE u.speaker_uuid = s.uuid)
          AND NOT (coalesce(s.name, '') <> '' AND (s.name_source IS NULL OR s.name_source = 'manual'))
          AND NOT EXISTS (SELECT 1 FROM attendee_mappings m WHERE m.speaker_uuid = s.uuid AND m.source = 'manual') AND coalesce(s.identity_state, 'active') <> 'alias'"""


def in_common(d: Spark, speakers: tuple = ("spk-user-1", "spk-assistant-1")) -> str:
    return f"SELECT recording_id AS id FROM utterances WHERE speaker_uuid IN ({', '.join(repr(s) for s in speakers)}) GROUP BY recording_id HAVING count(DISTINCT speaker_uuid) = {len(set(speakers))}"


def neighbours(d: Spark, around: int = 2) -> str:
    return f"""WITH hits AS (SELECT id, recording_id, utterance_index FROM utterances WHERE NOT is_hidden AND suspicion >= 0.4)
        SELECT h.id AS hit, u.id, u.utterance_index < h.utterance_index AS before FROM hits h JOIN utterances u ON u.recording_id = h.recording_id AND u.utterance_index BETWEEN h.utterance_index - {around} AND h.utterance_index + {around} AND u.id <> h.id AND NOT u.is_hidden"""


def overlapping_meetings(d: Spark, slack: int = 300) -> str:
    """Interval overlap by buckets of two hours: an equi-join on the bucket, then the predicate, and each pair once."""
    width = 7200
    span = lambda a, b: d.series(f"floor(({a}) / {width})", f"floor(({b}) / {width})")
    left = d.unnest(f"(SELECT id, created_at AS a, created_at + duration AS b, {span(f'created_at - {slack}', f'created_at + duration + {slack}')} AS xs FROM recordings) p", "xs", "bucket")
    right = d.unnest(f"(SELECT id, start_at, end_at, {span('start_at', 'end_at')} AS ys FROM meetings) q", "ys", "bucket")
    return f"SELECT DISTINCT r.id AS recording_id, m.id AS meeting_id FROM (SELECT id, a, b, bucket FROM {left}) r JOIN (SELECT id, start_at, end_at, bucket FROM {right}) m ON m.bucket = r.bucket AND m.start_at <= r.b + {slack} AND m.end_at >= r.a - {slack}"


def overlaps(d: Spark, left: str, right: str, width: float, pad: float = 0.0) -> str:
    """Pairs of rows l, r of one recording whose intervals, the left one widened by ``pad``, meet; each pair once.

    ``left`` and ``right``: relations with recording_id, start_time and end_time. Rows are put into the buckets of time
    that they touch and joined on recording and bucket, so a long recording is many small joins; a pair counts in the
    first bucket that both have.
    """
    a, b = f"floor((start_time - {pad}) / {width})", f"floor((end_time + {pad}) / {width})"
    lb = d.unnest(f"(SELECT *, {d.series(a, b)} AS buckets FROM {left} q) p", "buckets", "bucket")
    rb = d.unnest(f"(SELECT *, {d.series(f'floor(start_time / {width})', f'floor(end_time / {width})')} AS buckets FROM {right} q) p", "buckets", "bucket")
    return f"""(SELECT * FROM {lb}) l JOIN (SELECT * FROM {rb}) r ON l.recording_id = r.recording_id AND l.bucket = r.bucket
        AND l.bucket = greatest(floor((l.start_time - {pad}) / {width}), floor(r.start_time / {width}))"""


def tiered_meetings(d: Spark) -> str:
    """Meetings within twelve hours of a recording's interval: matched within 5 minutes, suggested within 45, else possible."""
    pair = overlaps(d, "(SELECT id, 0 AS recording_id, created_at AS start_time, created_at + coalesce(duration, 0) AS end_time FROM recordings)", "(SELECT id, 0 AS recording_id, start_at AS start_time, end_at AS end_time FROM meetings)", 43200, 43200)
    near = lambda s: f"r.start_time <= l.end_time + {s} AND r.end_time >= l.start_time - {s}"
    return f"SELECT l.id AS recording_id, r.id AS meeting_id, CASE WHEN {near(300)} THEN 'matched' WHEN {near(2700)} THEN 'suggested' ELSE 'possible' END AS tier FROM {pair} WHERE {near(43200)}"


_OVERLAP = "least(l.end_time, r.end_time) - greatest(l.start_time, r.start_time)"


def word_turns(d: Spark) -> str:
    """Words and the turns that they overlap: id, turn, speaker, o (seconds)."""
    return f"SELECT l.id, r.id AS turn, r.speaker, {_OVERLAP} AS o FROM {overlaps(d, 'words', 'turns', 16)} WHERE r.start_time < l.end_time AND r.end_time > l.start_time"


def most_overlap(d: Spark) -> str:
    """For each word the speaker with the greatest summed overlap, ties to the lower label; null without overlap."""
    return f"""WITH pairs AS ({word_turns(d)}), sums AS (SELECT id, speaker, sum(o) AS o FROM pairs GROUP BY id, speaker),
        best AS (SELECT id, speaker, row_number() OVER (PARTITION BY id ORDER BY o DESC, speaker) AS n FROM sums)
        SELECT w.id, b.speaker FROM words w LEFT JOIN best b ON b.id = w.id AND b.n = 1"""


def winner_turn(d: Spark) -> str:
    """As most_overlap, with the winner's turn of the longest overlap, ties to the first."""
    return f"""WITH pairs AS ({word_turns(d)}),
        best AS (SELECT id, speaker, row_number() OVER (PARTITION BY id ORDER BY sum(o) DESC, speaker) AS n FROM pairs GROUP BY id, speaker),
        each AS (SELECT p.id, p.speaker, p.turn, row_number() OVER (PARTITION BY p.id ORDER BY p.o DESC, p.turn) AS k FROM pairs p JOIN best b ON b.id = p.id AND b.speaker = p.speaker AND b.n = 1)
        SELECT id, speaker, turn FROM each WHERE k = 1"""


_MIDDLES = "(SELECT id, recording_id, word, start_time AS begun, (start_time + end_time) / 2 AS start_time, (start_time + end_time) / 2 AS end_time FROM words)"


def midpoint(d: Spark) -> str:
    """The turn that holds a word's middle (start <= mid < end): best quality, then lower label; else the most overlap."""
    return f"""WITH held AS (SELECT id, speaker FROM (SELECT l.id, r.speaker, row_number() OVER (PARTITION BY l.id ORDER BY r.quality DESC, r.speaker, r.id) AS n FROM {overlaps(d, _MIDDLES, "turns", 16)} WHERE r.start_time <= l.start_time AND r.end_time > l.start_time) x WHERE n = 1)
        SELECT w.id, coalesce(h.speaker, m.speaker) AS speaker FROM words w LEFT JOIN held h ON h.id = w.id LEFT JOIN ({most_overlap(d).replace("WITH pairs", "WITH met").replace("FROM pairs", "FROM met")}) m ON m.id = w.id"""


def words_in_turns(d: Spark) -> str:
    return f"SELECT r.id, {d.join('l.word', ' ', 'l.begun, l.id')} AS text FROM {overlaps(d, _MIDDLES, 'turns', 16)} WHERE r.start_time <= l.start_time AND r.end_time > l.start_time GROUP BY r.id"


def simultaneous(d: Spark, least: float = 0.35) -> str:
    return f"SELECT t.id, x.id IS NOT NULL AS simultaneous FROM turns t LEFT JOIN (SELECT DISTINCT l.id FROM {overlaps(d, 'turns', 'turns', 16)} WHERE l.id <> r.id AND {_OVERLAP} >= {least}) x ON x.id = t.id"


def echoes(d: Spark, near: float = 2.5, least: float = 0.5) -> str:
    """Microphone lines without those that repeat a system line whose time is within ``near`` seconds of theirs, at a
    similarity of their words of ``least`` or more."""
    toks = d.distinct(d.kept(d.find("lower(text)", r"[\p{L}\p{N}]+"), "w", "length(w) > 1"))
    same = f"{d.size(d.common('l.ws', 'r.ws'))} >= {least} * {d.size(d.union('l.ws', 'r.ws'))} AND {d.size('l.ws')} > 0 AND {d.size('r.ws')} > 0"
    return f"""WITH k AS (SELECT id, recording_id, start_time, end_time, {toks} AS ws, mic FROM channel_lines), dropped AS (SELECT DISTINCT l.id FROM {overlaps(d, "(SELECT * FROM k WHERE mic)", "(SELECT * FROM k WHERE NOT mic)", 60, near)}
          WHERE l.start_time <= r.end_time + {near} AND r.start_time <= l.end_time + {near} AND {same})
        SELECT k.id FROM k LEFT JOIN dropped x ON x.id = k.id WHERE k.mic AND x.id IS NULL"""


def timeline_evidence(d: Spark, overlap: float = 0.40, purity: float = 0.80, coverage: float = 0.45) -> str:
    """Old clusters of a recording and the new cluster that their time points to: the one with the most overlap, if that
    is ``overlap`` seconds at least, ``purity`` of all overlap and ``coverage`` of the old cluster's own time.
    """
    return f"""WITH old AS (SELECT id, recording_id, speaker, start_time, end_time FROM old_turns), islands AS (SELECT recording_id, speaker, min(start_time) AS a, max(end_time) AS b FROM (
            SELECT *, sum(new) OVER (PARTITION BY recording_id, speaker ORDER BY start_time, end_time, id ROWS UNBOUNDED PRECEDING) AS island FROM (
              SELECT *, CASE WHEN start_time <= max(end_time) OVER (PARTITION BY recording_id, speaker ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM old) t) i
            GROUP BY recording_id, speaker, island), whole AS (SELECT recording_id, speaker, sum(b - a) AS s FROM islands GROUP BY recording_id, speaker),
        o AS (SELECT l.recording_id, l.speaker AS target, r.speaker AS evidence, sum({_OVERLAP}) AS o FROM {overlaps(d, "old", "new_turns", 16)} WHERE r.start_time < l.end_time AND r.end_time > l.start_time GROUP BY l.recording_id, l.speaker, r.speaker),
        n AS (SELECT *, sum(o) OVER (PARTITION BY recording_id, target) AS seen, row_number() OVER (PARTITION BY recording_id, target ORDER BY o DESC, evidence) AS n FROM o)
        SELECT n.recording_id, n.target, n.evidence, round(n.o / n.seen, 6) AS purity, round(least(1, n.o / w.s), 6) AS coverage FROM n JOIN whole w ON w.recording_id = n.recording_id AND w.speaker = n.target
        WHERE n.n = 1 AND n.o >= {overlap} AND n.o / n.seen >= {purity} AND n.o / w.s >= {coverage}"""


def cosine(d: Spark, a: str, b: str) -> str:
    """Cosine in double precision; 0 if the dimensions differ, there are none, or a norm is zero."""
    n = f"(sqrt({d.dot(a, a)}) * sqrt({d.dot(b, b)}))"
    return f"CASE WHEN {d.size(a)} <> {d.size(b)} OR {d.size(a)} = 0 THEN 0e0 WHEN {n} > 0 THEN {d.dot(a, b)} / {n} ELSE 0e0 END"


def similar_pairs(d: Spark, least: float = 0.8, of_library: bool = False) -> str:
    """Pairs of voices of different recordings (of one library) that are similar enough, whoever they are said to be. All pairs are
    compared; :class:`colloquy.similar.Pairs` finds them without."""
    v = f"(SELECT vec_id, library_id, recording_id, embedding, sqrt({d.dot('embedding', 'embedding')}) AS norm FROM vectors)"
    within = "a.library_id = b.library_id AND " if of_library else ""
    return f"""SELECT a, b, round(c, 6) AS cosine FROM (SELECT a.vec_id AS a, b.vec_id AS b, {d.dot("a.embedding", "b.embedding")} / (a.norm * b.norm) AS c FROM {v} a JOIN {v} b ON {within}a.recording_id <> b.recording_id AND a.vec_id < b.vec_id WHERE a.norm > 0 AND b.norm > 0) p WHERE c >= {least}"""


PLANS = {
    "SRC-01": newest, "SRC-02": lookups, "SRC-03": prefix, "SRC-04": in_range, "SRC-05": children, "SRC-08": process_output, "SRC-10": tables,
    "SNK-01": csv_rows, "SNK-02": plain_text, "SNK-03": markdown, "SNK-04": subtitles, "SNK-05": labelled, "SNK-06": full_transcript, "SNK-07": upsert, "SNK-08": replace_part, "SNK-09": fingerprint, "SNK-10": backfill_keys,
    "FIL-01": browse, "FIL-02": library_filter, "FIL-03": all_tags, "FIL-04": has_speaker, "FIL-05": source_in, "FIL-06": linked_meeting, "FIL-07": has_parts, "FIL-08": text_contains, "FIL-09": keyset_page, "FIL-10": private,
    "FIL-11": private_meetings, "FIL-12": visible, "FIL-13": unsettled, "FIL-14": substring, "FIL-15": qualified_meetings, "FIL-16": upcoming,
    "JN-01": with_recording, "JN-02": display_name, "JN-03": bridges, "JN-04": co_appearance, "JN-05": talk_slice, "JN-06": untranscribed, "JN-07": orphans, "JN-08": in_common, "JN-09": neighbours, "JN-10": overlapping_meetings, "JN-11": tiered_meetings,
    "JN-12": most_overlap, "JN-13": winner_turn, "JN-14": midpoint, "JN-15": words_in_turns, "JN-16": simultaneous, "JN-17": echoes, "JN-19": timeline_evidence, "JN-20": similar_pairs,
}
