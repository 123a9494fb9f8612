"""Operators whose next step depends on what was decided before: ordered folds within one recording.

Each is a generator over one recording's rows in order. It holds what the next decision needs and nothing else, and gives a row
as soon as it is settled. :func:`per_recording` runs them: Spark deals recordings to tasks and sorts, and a task lets the rows
pass, batch by batch, so a recording may have any number of lines.
"""

from __future__ import annotations

import heapq
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a fold gives before they are handed on.
GIVEN = 2048
Rows = Iterable[dict]


def per_recording(rows: DataFrame, fold: Callable[[Rows], Rows], schema: str, order: list[str], key: str | list[str] = "recording_id") -> DataFrame:
    """Apply ``fold`` to each recording's rows (or those of another ``key``) in ``order``; its dicts become rows of ``schema``."""
    keys = [key] if isinstance(key, str) else key
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = (row for b in batches for row in b.to_pylist())
        made = (row for _, group in itertools.groupby(passing, lambda r: [r[k] for k in keys]) for row in fold(group))
        while some := list(itertools.islice(made, GIVEN)):
            yield pa.RecordBatch.from_pylist(some, shape)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def hit_order(r: dict) -> tuple:
    """Best hit first: score, then time, then place."""
    return (-r["score"], r["start_time"], r["utterance_index"])


def moments(rows: Rows, lines: int = 2, seconds: float = 20.0) -> Iterator[dict]:
    """Hits in order of time join a moment if they are near its first hit, not its last. The best hit stands for it."""

    def settled(group: list[dict]) -> dict:
        group = sorted(group, key=hit_order)
        return {c: group[0][c] for c in ("recording_id", "id", "score", "start_time", "utterance_index")} | {"members": [r["id"] for r in group]}

    group: list[dict] = []
    for r in rows:
        if group and not (abs(r["utterance_index"] - group[0]["utterance_index"]) <= lines or 0 < r["start_time"] - group[0]["start_time"] <= seconds):
            yield settled(group)
            group = []
        group.append(r)
    if group:
        yield settled(group)


def conversation(rows: Rows) -> Iterator[dict]:
    """A recording's hits as one result: the three best moments and the title, which adds a tenth of the best at most. A
    recording that only its title speaks for has the title's score and comes after all others."""
    title, recording = None, None

    def lines() -> Iterator[dict]:
        nonlocal title, recording
        for r in rows:
            recording = r["recording_id"]
            if r["field"] == "title":
                title = r["score"] if title is None else max(title, r["score"])
            else:
                yield r

    best: list[dict] = []
    n = 0
    for m in moments(lines()):
        n += 1
        best = sorted([*best, m], key=hit_order)[:3]
    score = title or 0.0
    if best:
        score = sum(w * m["score"] for w, m in zip((1.0, 0.2, 0.1), best, strict=False)) + min(title or 0.0, 0.1 * best[0]["score"])
    yield {"recording_id": recording, "score": score, "title_only": not n, "moments": n}


# Policies of the merge of lines. gap, seconds, words, seconds after which a sentence's end divides, whether
# who else speaks divides.
POLICIES = {"legacy": (1.0, None, None, None, False), "readable": (2.0, 60.0, 160, 25.0, True), "safe": (0.45, 10.0, 28, 4.0, True)}


def merge_segments(rows: Rows, policy: str = "readable") -> Iterator[dict]:
    """Lines in order join the segment so far, of one speaker, within the limits of a policy."""
    gap, longest, most_words, sentence, context = POLICIES[policy]
    last: dict | None = None
    texts: list[str] = []
    settled = lambda: last | {"text": " ".join(t for t in texts if t) if len(texts) > 1 else texts[0]}
    for r in rows:
        fits = last is not None and last["speaker"] == r["speaker"] and r["start_time"] - last["end_time"] <= gap and not (context and last["context"] != r["context"])
        fits = fits and not (longest is not None and max(last["end_time"], r["end_time"]) - last["start_time"] > longest) and not (most_words is not None and last["words"] + r["n_words"] > most_words)
        fits = fits and not (sentence is not None and last["end_time"] - last["start_time"] >= sentence and texts[-1].rstrip("\"')]»” ").endswith((".", "!", "?", "…")))
        if fits:
            last.update(end_time=max(last["end_time"], r["end_time"]), words=last["words"] + r["n_words"], lines=last["lines"] + 1)
            texts.append(r["text"])
        else:
            if last is not None:
                yield settled()
            last = {"recording_id": r["recording_id"], "policy": policy, "speaker": r["speaker"], "start_time": r["start_time"], "end_time": r["end_time"], "words": r["n_words"], "lines": 1, "context": r["context"]}
            texts = [r["text"]]
    if last is not None:
        yield settled()


def spans(rows: Rows, gap: float = 2.0, longest: float = 26.0, pad: float = 1.0, most: int = 6) -> Iterator[dict]:
    """Adjacent flagged lines as spans to listen to again, padded, with a flag where the length was clamped."""
    settled = lambda s: s | {"a": max(0.0, s["a"] - pad), "b": min(s["b"] + pad, s["a"] - pad + longest), "clamped": s["b"] - s["a"] + 2 * pad > longest}
    last: dict | None = None
    for r in rows:
        if last and r["start_time"] - last["b"] <= gap and r["end_time"] - last["a"] + 2 * pad <= longest and last["lines"] < most:
            last.update(b=r["end_time"], lines=last["lines"] + 1)
        else:
            if last:
                yield settled(last)
            last = {"recording_id": r["recording_id"], "a": r["start_time"], "b": r["end_time"], "lines": 1}
    if last:
        yield settled(last)


def in_parts(rows: Rows, longest: float) -> Iterator[tuple[float, float]]:
    """Intervals in order of their start, in parts of at most ``longest``, the parts in order. Parts that wait for later rows to begin
    are held: those of the intervals that reach over the row at hand."""
    waiting: list[tuple[float, float]] = []
    for r in rows:
        a, b = r["start_time"], r["end_time"]
        while waiting and waiting[0] < (a, a):
            yield heapq.heappop(waiting)
        for i in range(max(1, int(-(-(b - a) // longest)))):
            heapq.heappush(waiting, (a + i * longest, min(b, a + (i + 1) * longest)))
    while waiting:
        yield heapq.heappop(waiting)


def target_windows(rows: Rows, longest: float = 12.0, pad: float = 4.0, least: float = 8.0) -> Iterator[dict]:
    """Split long targets, merge those that overlap, group while a group stays within ``longest``, then pad."""
    recording = None

    def noted() -> Iterator[dict]:
        nonlocal recording
        for r in rows:
            recording = r["recording_id"]
            yield r

    def joined(parts: Iterable[tuple[float, float]], overlap: bool) -> Iterator[tuple[float, float]]:
        last: tuple[float, float] | None = None
        for a, b in parts:
            if last and (not overlap or a <= last[1]) and b - last[0] <= longest:
                last = (last[0], max(b, last[1]) if overlap else b)
            else:
                if last:
                    yield last
                last = (a, b)
        if last:
            yield last

    for a, b in joined(joined(in_parts(noted(), longest), True), False):
        wide = max(pad, (least - (b - a)) / 2)
        yield {"recording_id": recording, "a": max(0.0, a - wide), "b": b + wide}


def capped_pairs(rows: Rows, most: int = 3, top: int | None = None) -> Iterator[dict]:
    """The best pairs in order, none of whose ends has been used ``most`` times; the first ``top``. Holds a number for each
    end that was used."""
    used: dict = {}
    n = 0
    for r in rows:
        if (top is None or n < top) and used.get(r["a"], 0) < most and used.get(r["b"], 0) < most:
            used[r["a"]] = used.get(r["a"], 0) + 1
            used[r["b"]] = used.get(r["b"], 0) + 1
            n += 1
            yield r


def pack_sentences(rows: Rows, most: int = 50, chunk: int = 100) -> Iterator[dict]:
    """Sentences are added while together they have fewer than ``most`` words; text without sentences goes by words."""
    for r in rows:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", r["text"]) if s.strip()]
        if len(sentences) <= 1:
            words = r["text"].split()
            packed = [" ".join(words[i : i + chunk]) for i in range(0, len(words), chunk)]
        else:
            packed, n = [], 0
            for s in sentences:
                more = len(s.split())
                if packed and n + more < most:
                    packed[-1].append(s)
                    n += more
                else:
                    packed.append([s])
                    n = more
            packed = [" ".join(p) for p in packed]
        yield from ({"recording_id": r["recording_id"], "id": r["id"], "part": i, "text": p} for i, p in enumerate(packed))


def stitch(rows: Rows, most: int = 12) -> Iterator[dict]:
    """Each text without the words that the text so far ends with; a single shared word counts from five letters. Of the text so
    far, its last ``most`` words are held."""
    fold = lambda ws: [w.lower().strip(".,;:!?") for w in ws]
    said: list[str] = []
    for r in rows:
        new = r["text"].split()
        k = next((k for k in range(min(most, len(said), len(new)), 0, -1) if fold(said[-k:]) == fold(new[:k]) and (k > 1 or len(new[0]) >= 5)), 0)
        said = (said + new[k:])[-most:]
        yield {"recording_id": r["recording_id"], "id": r["id"], "overlap": k, "added": " ".join(new[k:])}


def split_points(rows: Rows, target: float = 60.0, longest: float = 120.0) -> Iterator[dict]:
    """The first silence at least ``target`` after the last split; one more if the rest is too long."""
    last, end, recording = 0.0, 0.0, None
    for r in rows:
        end, recording = max(end, r["end_time"]), r["recording_id"]
        if r["at"] - last >= target:
            yield {"recording_id": recording, "at": float(r["at"])}
            last = r["at"]
    if end - last > longest:
        yield {"recording_id": recording, "at": float(last + (end - last) / 2)}


def pack_spans(rows: Rows, gap: float = 2.0, longest: float = 29.5, pad: float = 1.0) -> Iterator[dict]:
    """Spans of bounded length with padding; a segment that is too long alone is split hard."""
    inner = longest - 2 * pad
    settled = lambda r, a, b: {"recording_id": r["recording_id"], "a": max(0.0, a - pad), "b": min(b + pad, max(0.0, a - pad) + longest)}
    last: tuple[float, float] | None = None
    r: dict = {}
    for r in rows:
        a = r["start_time"]
        while True:
            b = a + inner if r["end_time"] - a > inner else r["end_time"]
            if last and a - last[1] <= gap and b - last[0] <= inner:
                last = (last[0], max(last[1], b))
            else:
                if last:
                    yield settled(r, *last)
                last = (a, b)
            if b == r["end_time"]:
                break
            a += inner
    if last:
        yield settled(r, *last)


def collapse(rows: Rows, near: float = 0.15) -> Iterator[dict]:
    """Without rows that repeat the last row kept: both ends near and the text equal but for case."""
    k: dict | None = None
    for r in rows:
        if k and abs(k["start_time"] - r["start_time"]) <= near and abs(k["end_time"] - r["end_time"]) <= near and k["text"].lower() == r["text"].lower():
            continue
        k = r
        yield r


def claim(rows: Rows, most: float = 60.0) -> Iterator[dict]:
    """Each decision, in order, claims the nearest line that none before it has, at most ``most`` seconds away.

    ``rows`` are those of one text in one recording: first the lines (decides is false) in order of start, then the decisions.
    Three numbers are held of each line, and a decision looks at those that are near it.
    """
    starts, ends, ids, taken = [], [], [], None
    length = 0.0
    for r in rows:
        if not r["decides"]:
            starts.append(r["start_time"])
            ends.append(r["end_time"])
            ids.append(r["id"])
            length = max(length, r["end_time"] - r["start_time"])
            continue
        if taken is None:
            starts, ends, ids, taken = np.array(starts), np.array(ends), np.array(ids, dtype=np.int64), np.zeros(len(ids), dtype=bool)
        here = slice(bisect_left(starts, r["start_time"] - most - length), bisect_right(starts, r["end_time"] + most))
        gap = np.maximum(0.0, np.maximum(starts[here] - r["end_time"], r["start_time"] - ends[here]))
        free = np.flatnonzero(~taken[here] & (gap <= most))
        if len(free):
            best = here.start + int(free[np.lexsort((ids[here][free], gap[free]))[0]])
            taken[best] = True
            yield {"recording_id": r["recording_id"], "decision": r["id"], "line": int(ids[best])}


def ema(rows: Rows, keep: float = 0.9) -> Iterator[dict]:
    """A vector moved towards each new one and brought back to length 1."""
    v, n, uuid = None, 0, None
    for r in rows:
        x = np.asarray(r["embedding"], dtype=float)
        v = x if v is None else keep * v + (1 - keep) * x
        v = v / (np.linalg.norm(v) or 1.0)
        n, uuid = n + 1, r["speaker_uuid"]
    yield {"speaker_uuid": uuid, "n": n, "embedding": v.tolist()}


def exemplars(rows: Rows, most_words: int = 8) -> Iterator[dict]:
    """One text's history, in order: learning adds to its count and may raise its source, unlearning takes from it; at
    nothing it is forgotten, source and all. Texts of more words aren't learned."""
    rank = ("detector", "verifier", "user")
    count, source, text = 0, None, None
    for r in rows:
        text = r["text"]
        if r["learn"]:
            if text and len(text.split()) <= most_words:
                count, source = count + 1, max(source or "detector", r["source"], key=rank.index)
        elif count:
            count -= 1
            source = source if count else None
    if count:
        yield {"text": text, "occurrences": count, "source": source}


def match_ends(reference: list[float], candidate: list[float], most: float = 0.75) -> int:
    """How many ends of the reference, in order, find an end of the candidate near enough; each is taken once, the nearest
    first, the earlier in a tie."""
    left, matched = sorted(candidate), 0
    for end in sorted(reference):
        best = min(range(len(left)), key=lambda i: (abs(left[i] - end), i), default=None)
        if best is not None and abs(left[best] - end) <= most:
            left.pop(best)
            matched += 1
    return matched


# Fixed values of the voice detector: first noise floor, bounds of the threshold and its factor over the floor, least peak,
# weight of the floor so far, blocks to start and to end.
FLOOR, LOW, HIGH, FACTOR, PEAK, KEEP, START, END = 0.0015, 0.0025, 0.03, 3.2, 0.008, 0.97, 4, 18


def hear(state: tuple[float, bool, int, int], rms: float, peak: float) -> tuple[tuple[float, bool, int, int], bool]:
    """One block: (noise floor, speaking, loud blocks, quiet blocks) -> the state after it, and whether speaking changed."""
    floor, speaking, loud, quiet = state
    if rms >= max(LOW, min(HIGH, floor * FACTOR)) and peak >= PEAK:
        loud, quiet = loud + 1, 0
        begins = not speaking and loud >= START
        return (floor, speaking or begins, loud, quiet), begins
    if not speaking:
        return (floor * KEEP + rms * (1 - KEEP), False, 0, quiet), False
    quiet += 1
    ends = quiet >= END
    return (floor, not ends, 0, 0 if ends else quiet), ends


def detect_voice(blocks: list[tuple[float, float]]) -> list[tuple[int, bool]]:
    """Changes of state over blocks of (rms, peak): (block, speaking)."""
    state, out = (FLOOR, False, 0, 0), []
    for i, (rms, peak) in enumerate(blocks):
        state, changed = hear(state, rms, peak)
        if changed:
            out.append((i, state[1]))
    return out
