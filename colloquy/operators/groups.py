"""Clustering, assignment and identity over candidate edges: small graphs, one scope (a recording, a library) each.

Spark makes the candidates (see the plans for cosines and overlaps); the decisions here are functions over one scope,
applied as grouped pandas functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np


def cosines(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    y = x / np.where(n > 0, n, 1)
    return y @ y.T


def components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The least member of each node's component."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def single_linkage(x: np.ndarray, least: float = 0.8) -> list[int]:
    c = cosines(x)
    return components(len(x), [(i, j) for i in range(len(x)) for j in range(i) if c[i, j] >= least])


def linkage(x: np.ndarray, least: float, kind: str = "complete", k: int | None = None, apart: set[frozenset[int]] = frozenset()) -> list[int]:
    """Agglomerative clusters: merge the pair with the strongest worst (complete) or mean (average) cosine while it
    reaches ``least``, or until ``k`` are left. Pairs in ``apart`` never meet. Ties go to the lower members."""
    n = len(x)
    s, sizes, of = cosines(x), np.ones(n), np.arange(n)
    np.fill_diagonal(s, -np.inf)
    for i, j in (sorted(p) for p in apart):
        s[i, j] = s[j, i] = -np.inf
    # Each group's strongest partner among those after it; a merge changes those of few groups.
    to, best = np.zeros(n, dtype=int), np.full(n, -np.inf)

    def look(i: int) -> None:
        if i + 1 < n:
            later = np.round(s[i, i + 1 :], 12)
            to[i] = i + 1 + int(later.argmax())
            best[i] = later[to[i] - i - 1]

    for i in range(n):
        look(i)
    for _ in range(n - (k or 1)):
        a = int(best.argmax())
        if best[a] == -np.inf or (k is None and best[a] < least):
            break
        b = int(to[a])
        with np.errstate(invalid="ignore"):
            row = np.minimum(s[a], s[b]) if kind == "complete" else np.maximum(s[a], s[b]) if kind == "single" else (s[a] * sizes[a] + s[b] * sizes[b]) / (sizes[a] + sizes[b])
        row[np.isneginf(s[a]) | np.isneginf(s[b])] = -np.inf
        s[a], s[:, a], s[b], s[:, b] = row, row, -np.inf, -np.inf
        sizes[a] += sizes[b]
        best[b] = -np.inf
        of[of == b] = a
        stale = np.flatnonzero((best > -np.inf) & ((to == a) | (to == b)))
        for i in {a, *stale.tolist()}:
            look(i)
        value = np.round(s[:a, a], 12)
        nearer = np.flatnonzero((value > best[:a]) | ((value == best[:a]) & (value > -np.inf) & (a < to[:a])))
        best[nearer], to[nearer] = value[nearer], a
    return of.tolist()


def dbscan(x: np.ndarray, eps: float, least: int) -> list[int]:
    """Density clusters on cosine distance by row (rows with equal vectors stay distinct); noise is its own cluster."""
    near = 1 - cosines(x) <= eps + 1e-12
    core = near.sum(axis=1) >= least
    ids = np.flatnonzero(core)
    label = components(len(x), [(int(i), int(j)) for i in ids for j in ids if j < i and near[i, j]])
    return [label[i] if core[i] else min((label[j] for j in ids if near[i, j]), default=i) for i in range(len(x))]


def dbscan_sweep(x: np.ndarray, sweep: tuple[float, ...] = (0.05, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3)) -> list[int]:
    """The sweep's best clustering by similarity within clusters, fewer clusters and less noise."""
    n = len(x)
    least, c, best = max(2, min(8, n // 25)), cosines(x), None
    for eps in sweep:
        label = np.array(dbscan(x, eps, least))
        sizes = np.bincount(label, minlength=n)
        noise, k = (sizes == 1).sum() / n, (sizes > 0).sum()
        same = np.triu(label[:, None] == label[None, :], 1)
        score = (float(c[same].mean()) if same.any() else 0.0) * (1 - 0.5 * k / n) * (1 - 0.5 * noise)
        if best is None or score > best[0] + 1e-12:
            best = (score, label.tolist())
    return best[1] if best else []


def meets(a: list[tuple[float, float]], b: list[tuple[float, float]], tolerance: float = 0.20) -> bool:
    """Whether two sets of time spans have more than ``tolerance`` seconds at once somewhere: then it isn't one voice."""
    return any(min(x[1], y[1]) - max(x[0], y[0]) > tolerance for x in a for y in b)


def _clash(nodes: list[dict]) -> np.ndarray:
    """Pairs of nodes of one recording that speak at the same time."""
    n = len(nodes)
    out = np.zeros((n, n), dtype=bool)
    of: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        of.setdefault(x["recording_id"], []).append(i)
    for members in of.values():
        for i, j in combinations(members, 2):
            out[i, j] = out[j, i] = meets(nodes[i]["spans"], nodes[j]["spans"])
    return out


def _supported(c: np.ndarray, g: list[int], h: list[int], floor: float) -> bool:
    """Whether each member of the smaller group has a partner in the other at ``floor`` or more."""
    small, large = (g, h) if len(g) <= len(h) else (h, g)
    return bool((np.nanmax(np.where(np.isnan(c[np.ix_(small, large)]), -np.inf, c[np.ix_(small, large)]), axis=1) >= floor).all())


def evidence_graph(nodes: list[dict], threshold: float = 0.65, slack: float = 0.15, exceptional: float = 0.12, together: float = 0.20) -> list[int]:
    """Voices of recordings (recording_id, embedding, spans, reliable) as people: for each the least member of its group.

    Groups merge, the strongest pair of groups first (0.7 of the best cosine, 0.3 of the mean of the three best), if the
    best reaches ``threshold``. A single pair of voices must be exceptional; otherwise two pairs at least and every
    member of the smaller group must come within ``slack``. Groups that share two recordings need more. Voices that speak
    at the same time, or aren't reliable, never merge. Only pairs of different recordings are evidence.
    """
    n = len(nodes)
    c = cosines(np.array([x["embedding"] for x in nodes], dtype=float).reshape(n, -1)) if n else np.zeros((0, 0))
    rec = np.array([x["recording_id"] for x in nodes])
    good = np.array([bool(x.get("reliable", True)) for x in nodes], dtype=bool)
    c = np.where((rec[:, None] != rec[None, :]) & good[:, None] & good[None, :], c, np.nan)
    clash, groups = _clash(nodes), {i: [i] for i in range(n)}

    def evidence(a: int, b: int) -> tuple | None:
        g, h = groups[a], groups[b]
        if clash[np.ix_(g, h)].any():
            return None
        scores = c[np.ix_(g, h)].ravel()
        scores = np.sort(scores[~np.isnan(scores)])[::-1]
        if not len(scores) or scores[0] < threshold:
            return None
        support = int((scores >= threshold - slack).sum())
        if len(scores) == 1:
            if scores[0] < threshold + exceptional:
                return None
        elif support < 2 or not _supported(c, g, h, threshold - slack):
            return None
        if len(set(rec[g].tolist()) & set(rec[h].tolist())) >= 2 and (scores[0] < threshold + together or len(scores) < 2 or scores[1] < threshold + max(0.08, together / 2)):
            return None
        return (-round(0.7 * scores[0] + 0.3 * float(scores[:3].mean()), 9), -round(scores[0], 9), -support, a, b)

    # Only pairs of groups with an edge at the threshold can merge; what a merge doesn't touch keeps its evidence.
    beside: dict[int, set[int]] = {i: set() for i in groups}
    known: dict[tuple[int, int], tuple | None] = {}
    for i, j in np.argwhere(np.triu(np.nan_to_num(c, nan=-2.0) >= threshold, 1)).tolist():
        beside[i].add(j)
        beside[j].add(i)
        known[i, j] = evidence(i, j)
    heap = [e for e in known.values() if e is not None]
    heapify(heap)
    while heap:
        e = heappop(heap)
        *_, a, b = e
        if known.get((a, b)) is not e:
            continue  # one of both has changed since
        groups[a] = sorted(groups[a] + groups.pop(b))
        near = (beside[a] | beside.pop(b)) - {a, b}
        for x in near:
            for k in (a, b):
                known.pop((min(k, x), max(k, x)), None)
            beside[x] = (beside[x] - {b}) | {a}
            pair = min(a, x), max(a, x)
            known[pair] = evidence(*pair)
            if known[pair] is not None:
                heappush(heap, known[pair])
        known.pop((a, b))
        beside[a] = near
    return _least(groups, n)


def _least(groups: dict[int, list[int]], n: int) -> list[int]:
    out = [0] * n
    for g in groups.values():
        for i in g:
            out[i] = min(g)
    return out


@dataclass(frozen=True)
class Model:
    """A logistic model of a pair's cosine and of how far it stands out from the cohort (z), both standardised first."""

    bias: float
    cosine: float
    z: float
    cosine_mean: float
    cosine_scale: float
    z_mean: float
    z_scale: float

    def least(self, p: float) -> float:
        """The least cosine with a probability of ``p``, by the cosine alone; only for models that grow with it."""
        if self.cosine <= 0:
            return -1.0
        logit = np.log(p / (1 - p)) - self.bias - self.z * -self.z_mean / self.z_scale
        return float(self.cosine_mean + logit * self.cosine_scale / self.cosine)

    def __call__(self, cosine: np.ndarray, z: np.ndarray | float = 0.0) -> np.ndarray:
        """The probability that a pair is one person."""
        logit = self.bias + self.cosine * (np.asarray(cosine) - self.cosine_mean) / self.cosine_scale + self.z * (np.asarray(z) - self.z_mean) / self.z_scale
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


# The model before anything is learned.
probability = Model(bias=-0.4, cosine=1.35, z=0.15, cosine_mean=0.55, cosine_scale=0.10, z_mean=0.0, z_scale=1.0)
#: Where pairs are merged before anything is learned, the margin over the likeliest pair of different people, and its bounds.
MERGE, OVER, BOUNDS = 0.88, 0.03, (0.60, 0.985)


def reconcile(nodes: list[dict], must: list[tuple[int, int]] = (), cannot: list[tuple[int, int]] = (), anchors: dict[int, str] | None = None, merge: float = 0.88, slack: float = 0.16, single: float = 0.985, margin: float = 0.035, repeated: float = 0.96, model=probability) -> list[int]:
    """Voices of recordings as people under constraints: for each the least member of its group.

    Voices with one anchor, and those that must be linked, are together from the start. Edges, by falling probability,
    merge two groups at ``merge`` or more, unless anchors differ, a pair must not be linked, or two speak at once. A single
    edge must be mutual: each the other's nearest, by ``margin`` over the next (less if it is as good as certain).
    Otherwise two edges and all of the smaller group must come within ``slack``. Groups that share two recordings need
    ``repeated``.
    """
    n, anchors = len(nodes), anchors or {}
    good = [i for i in range(n) if nodes[i].get("reliable", True)]
    c = cosines(np.array([x["embedding"] for x in nodes], dtype=float).reshape(n, -1)) if n else np.zeros((0, 0))
    rec = np.array([x["recording_id"] for x in nodes])
    p = np.where(rec[:, None] != rec[None, :], model(c), np.nan)
    ok = np.zeros(n, dtype=bool)
    ok[good] = True
    p[~ok, :] = p[:, ~ok] = np.nan
    apart = _clash(nodes)
    for i, j in cannot:
        apart[i, j] = apart[j, i] = True
    groups, of = {i: [i] for i in range(n)}, list(range(n))

    def conflict(a: int, b: int) -> bool:
        left, right = ({anchors[i] for i in groups[x] if i in anchors} for x in (a, b))
        return bool(left and right and left != right) or bool(apart[np.ix_(groups[a], groups[b])].any())

    def join(a: int, b: int) -> None:
        groups[a] += groups.pop(b)
        for i in groups[a]:
            of[i] = a

    by_anchor: dict[str, list[int]] = {}
    for i in good:
        if i in anchors:
            by_anchor.setdefault(anchors[i], []).append(i)
    for members in by_anchor.values():
        for i in members[1:]:
            join(of[members[0]], of[i])
    for i, j in must:
        if ok[i] and ok[j] and of[i] != of[j] and not conflict(of[i], of[j]):
            join(of[i], of[j])
    q = np.where(np.isnan(p), -1.0, p)
    best = [int(np.argmax(q[i])) if n and (q[i] >= 0).any() else -1 for i in range(n)]
    second = np.partition(q, -2, axis=1)[:, -2].tolist() if n > 1 else [-1.0] * n
    edges = sorted((-p[i, j], i, j) for i, j in np.argwhere(np.triu(q >= merge - slack, 1)).tolist())
    floor = np.where(q >= merge - slack, q, np.nan)
    for _, i, j in edges:
        a, b = of[i], of[j]
        if a == b or conflict(a, b):
            continue
        scores = floor[np.ix_(groups[a], groups[b])].ravel()
        scores = np.sort(scores[~np.isnan(scores)])[::-1]
        if not len(scores) or scores[0] < merge:
            continue
        if len(scores) == 1:
            x, y = groups[a][0], groups[b][0]
            need = min(0.01, margin) if scores[0] >= single else margin
            if best[x] != y or best[y] != x or any(second[k] >= 0 and q[k, best[k]] - second[k] < need for k in (x, y)):
                continue
        elif not _supported(floor, groups[a], groups[b], merge - slack):
            continue
        if len(set(rec[groups[a]].tolist()) & set(rec[groups[b]].tolist())) >= 2 and scores[0] < repeated:
            continue
        join(a, b)
    return _least(groups, n)


def optimal(score: np.ndarray, least: float, margin: float = 0.0) -> list[tuple[int, int]]:
    """One-to-one pairs with the greatest sum over those that are eligible: at ``least`` or more and, with a ``margin``, that
    much over the row's other columns."""
    if not score.size:
        return []
    other = np.array([[np.delete(row, j).max(initial=-1.0) for j in range(len(row))] for row in score])
    ok = (score >= least) & ((margin <= 0) | (score - other >= margin))
    return [(i, j) for i, j in hungarian(np.where(ok, score - least + 1e-6, -1e6)) if ok[i, j]]


def consensus(clusters: list[dict], profiles: list[dict], threshold: float = 0.85, margin: float = 0.0) -> list[str | None]:
    """The known speaker (uuid) of each new voice of a recording, or None.

    clusters: embedding, spans, reliable. profiles: uuid, mean, prototypes. A profile's score is the greater of the cosine to
    its mean and of 0.7 of the best prototype and 0.3 of the three best. First one to one, the greatest sum over what is
    eligible; then a voice may share a profile that is taken, on stricter terms and if the two never speak at once.
    """
    if not clusters or not profiles:
        return [None] * len(clusters)
    one = lambda a, b: float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1))

    def judged(x, profile) -> tuple[float, float, int]:
        mean, s = one(x, profile["mean"]), sorted((one(x, y) for y in profile["prototypes"]), reverse=True)
        if not s:
            return mean, mean, int(mean >= threshold - 0.08)
        floor = max(0.30, min(threshold - 0.08, s[0] - 0.20))
        return max(mean, 0.7 * s[0] + 0.3 * float(np.mean(s[:3]))), s[0], sum(v >= floor for v in s)

    table = [[judged(np.asarray(c["embedding"], dtype=float), p) for p in profiles] for c in clusters]
    value = np.array([[t[0] for t in row] for row in table])
    ok = np.zeros(value.shape, dtype=bool)
    for i, c in enumerate(clusters):
        for j, p in enumerate(profiles):
            other = max((value[i, k] for k in range(len(profiles)) if k != j), default=-1.0)
            if not c.get("reliable", True) or value[i, j] < threshold or (margin > 0 and value[i, j] - other < margin):
                continue
            ok[i, j] = table[i][j][2] >= 2 or value[i, j] >= min(0.98, threshold + 0.10) if len(p["prototypes"]) >= 2 else value[i, j] >= min(0.98, threshold + 0.03)
    out: list[int | None] = [None] * len(clusters)
    taken: dict[int, list[int]] = {}
    for i, j in hungarian(np.where(ok, value - threshold + 1e-6, -1e6)):
        if ok[i, j]:
            out[i] = j
            taken.setdefault(j, []).append(i)
    for i, c in enumerate(clusters):
        if out[i] is not None or not c.get("reliable", True):
            continue
        first, *rest = sorted(range(len(profiles)), key=lambda j: (-value[i, j], profiles[j]["uuid"]))
        runner = value[i, rest[0]] if rest else -1.0
        strong = (len(profiles[first]["prototypes"]) >= 2 and table[i][first][2] >= 2) or table[i][first][1] >= min(0.98, threshold + 0.12)
        if value[i, first] >= min(0.98, threshold + 0.04) and value[i, first] - runner >= max(margin, 0.06) and strong and first in taken and not any(meets(c["spans"], clusters[k]["spans"]) for k in taken[first]):
            out[i] = first
            taken[first].append(i)
    return [None if j is None else profiles[j]["uuid"] for j in out]


def consolidation(source: dict, candidates: list[dict], threshold: float = 0.85, margin: float = 0.0) -> dict | None:
    """The speaker that a fragment belongs to, or None. Speakers: uuid, name, manual, mean, prototypes, occurrences (recording
    -> spans).

    A target has three prototypes at least. A fragment has two at most, unless both bear the same confirmed name; two
    different confirmed names never meet, nor do two who speak at once. The best target must reach the threshold, lead by
    the margin (0.10 at least), and two prototypes must support it.
    """
    if not source["prototypes"]:
        return None
    fold = lambda x: (x["name"] or "").strip().lower() or None
    one = lambda a, b: float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1))
    scored = []
    for t in candidates:
        busy = any(meets(spans, t["occurrences"].get(r, [])) for r, spans in source["occurrences"].items())
        if t["uuid"] == source["uuid"] or len(t["prototypes"]) < 3 or busy:
            continue
        both = source["manual"] and t["manual"]
        if both and fold(source) != fold(t) or not (both and fold(source) or len(source["prototypes"]) <= 2):
            continue
        s = sorted((one(a, b) for a in source["prototypes"] for b in t["prototypes"]), reverse=True)
        scored.append((max(one(source["mean"], t["mean"]), float(np.mean(s[:3]))), len(t["prototypes"]), t["uuid"], sum(v >= max(0.65, threshold - 0.08) for v in s)))
    if not scored:
        return None
    scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
    best, runner = scored[0], scored[1][0] if len(scored) > 1 else -1.0
    if best[0] < threshold or best[0] - runner < max(0.10, margin) or best[3] < 2:
        return None
    return {"uuid": source["uuid"], "target": best[2], "score": best[0], "margin": best[0] - runner, "support": best[3]}


def review_pairs(samples: list[dict], limit: int = 50, reviewed: frozenset = frozenset(), pairs: int = 700, pool: int = 4, usage: int = 3) -> list[dict]:
    """Pairs of voices that a person should be asked about, the most telling first. Samples: id, recording_id, uuid, embedding,
    mixed.

    Within a speaker: its two least typical voices, each with the most typical one of another recording (92 points and 130
    for each unit of cosine under 0.72). Between speakers: of the ``pairs`` most similar pairs the best of four by four
    voices of different recordings (58 points and 120 for each unit over 0.30). No voice is asked about more than ``usage``
    times. Mixed voices aren't asked about.
    """
    fine = sorted((s for s in samples if not s["mixed"]), key=lambda s: s["id"])
    if not fine or limit <= 0:
        return []
    x = np.array([s["embedding"] for s in fine], dtype=float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    of: dict[str, list[int]] = {}
    for i, s in enumerate(fine):
        of.setdefault(s["uuid"] or f"alone:{s['id']}", []).append(i)
    keys = sorted(of)
    centre = np.array([(m := x[of[k]].mean(axis=0)) / (np.linalg.norm(m) or 1) for k in keys])
    found: list[tuple] = []

    def ask(i: int, j: int, points: float, reason: str) -> None:
        a, b = sorted((fine[i]["id"], fine[j]["id"]))
        if (a, b) not in reviewed:
            found.append((-round(points, 9), a, b, reason))

    for k, m in zip(keys, centre, strict=True):
        typical = sorted(of[k], key=lambda i: (float(x[i] @ m), fine[i]["id"]))
        for i in typical[:2] if len(typical) >= 2 else []:
            anchor = next((j for j in reversed(typical) if j != i and fine[j]["recording_id"] != fine[i]["recording_id"]), None)
            if anchor is not None:
                ask(i, anchor, 92 + 130 * max(0.0, 0.72 - float(x[i] @ x[anchor])), "varies")
    near = centre @ centre.T
    order = sorted(((-round(float(near[a, b]), 9), a, b) for a in range(len(keys)) for b in range(a + 1, len(keys))))[:pairs]
    for _, a, b in order:
        left = sorted(of[keys[a]], key=lambda i: (-float(x[i] @ centre[b]), fine[i]["id"]))[:pool]
        right = sorted(of[keys[b]], key=lambda i: (-float(x[i] @ centre[a]), fine[i]["id"]))[:pool]
        pick = max(((float(x[i] @ x[j]), -i, -j) for i in left for j in right if fine[i]["recording_id"] != fine[j]["recording_id"]), default=None)
        if pick:
            ask(-pick[1], -pick[2], 58 + 120 * max(0.0, pick[0] - 0.30), "confusable")
    out, used, seen = [], {}, set()
    for points, a, b, reason in sorted(found):
        if len(out) < limit and (a, b) not in seen and used.get(a, 0) < usage and used.get(b, 0) < usage:
            seen.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append({"a": a, "b": b, "points": -points, "reason": reason})
    return out


def diarisation(reference: list[dict], predicted: list[dict]) -> dict:
    """A recording's reference and predicted segments (speaker, start_time, end_time, n_words): seconds missed, falsely
    heard and confused under the best mapping of speakers, words given to the wrong one under the best mapping by words,
    and the segments that mix speakers."""
    refs, hyps = (sorted({s["speaker"] for s in x if s["speaker"] is not None}) for x in (reference, predicted))
    both = lambda a, b: max(0.0, min(a["end_time"], b["end_time"]) - max(a["start_time"], b["start_time"]))

    def mapping(by_words: bool) -> dict[str, str]:
        w = np.zeros((len(hyps), len(refs)))
        for r in reference:
            for h in predicted:
                if r["speaker"] is not None and h["speaker"] is not None and (o := both(r, h)) > 0:
                    w[hyps.index(h["speaker"]), refs.index(r["speaker"])] += o * r["n_words"] / max(r["end_time"] - r["start_time"], 1e-9) if by_words else o
        return {hyps[i]: refs[j] for i, j in hungarian(w) if w[i, j] > 0} if w.size else {}

    by_time, by_words = mapping(False), mapping(True)
    out = dict.fromkeys(("missed", "false_alarm", "confused", "seconds", "words", "word_errors", "mixed", "scored"), 0.0)
    ends = sorted({t for s in [*reference, *predicted] for t in (s["start_time"], s["end_time"])})
    for a, b in zip(ends, ends[1:], strict=False):
        at = (a + b) / 2
        on = [{s["speaker"] for s in x if s["speaker"] is not None and s["start_time"] <= at < s["end_time"]} for x in (reference, predicted)]
        said = {by_time.get(s, ("unmapped", s)) for s in on[1]}
        right = len(on[0] & said)
        out["missed"] += max(0, len(on[0]) - len(said)) * (b - a)
        out["false_alarm"] += max(0, len(said) - len(on[0])) * (b - a)
        out["confused"] += max(0, min(len(on[0]), len(said)) - right) * (b - a)
    for r in reference:
        if r["speaker"] is None:
            continue
        out["seconds"] += r["end_time"] - r["start_time"]
        out["words"] += r["n_words"]
        heard: dict[str, float] = {}
        for h in predicted:
            if h["speaker"] is not None:
                heard[h["speaker"]] = heard.get(h["speaker"], 0.0) + both(r, h)
        winner = min(heard, key=lambda s: (-heard[s], s), default=None)
        out["word_errors"] += r["n_words"] if by_words.get(winner) != r["speaker"] else 0
    for h in predicted:
        spoke = {r["speaker"] for r in reference if r["speaker"] is not None and both(r, h) > 0.05}
        if h["speaker"] is not None and spoke:
            out["scored"] += 1
            out["mixed"] += len(spoke) > 1
    return out | {"reference_speakers": float(len(refs)), "predicted_speakers": float(len(hyps)), "segments": float(len(predicted)), "reference_segments": float(len(reference))}


def mixture(x: np.ndarray, gain: float = 0.08, apart: float = 0.70) -> bool:
    """Whether two seeds explain a cluster clearly better than one: it holds two voices. The seeds are the vector furthest from
    the centre and the one furthest from that."""
    n = len(x)
    if n < 6:
        return False
    y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = lambda m: m.mean(axis=0) / (np.linalg.norm(m.mean(axis=0)) or 1)
    one = centre(y)
    i = int(np.argmin(y @ one))
    j = int(np.argmin(y @ y[i]))
    side = y @ y[i] >= y @ y[j]
    if min(side.sum(), (~side).sum()) < 2:
        return False
    a, b = centre(y[side]), centre(y[~side])
    return bool(np.maximum(y @ a, y @ b).mean() - (y @ one).mean() >= gain and a @ b <= apart)


def greedy(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """One-to-one pairs by falling score, ties to lower indices."""
    order = sorted((-score[i, j], i, j) for i in range(score.shape[0]) for j in range(score.shape[1]) if score[i, j] >= least)
    rows, cols, out = set(), set(), []
    for _, i, j in order:
        if i not in rows and j not in cols:
            rows.add(i), cols.add(j), out.append((i, j))
    return out


def hungarian(score: np.ndarray, stay: float = 0.0) -> list[tuple[int, int]]:
    """One-to-one pairs with the greatest sum; a row may stay alone for ``stay``. Shortest augmenting paths."""
    n, m = score.shape
    cost = -np.hstack([score, np.full((n, n), stay)])
    m += n
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            free = ~used
            free[0] = False
            cur = np.concatenate([[np.inf], cost[match[j0] - 1] - u[match[j0]] - v[1:]])
            better = free & (cur < low)
            low[better], way[better] = cur[better], j0
            j1 = int(np.argmin(np.where(free, low, np.inf)))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m - n + 1) if match[j])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.35, steps: int = 700, rate: float = 0.1) -> Model | None:
    """The model of labelled pairs (rows of cosine and z; 1 for one person): logistic regression in which both classes weigh the same, the
    weights of the features held back by ``ridge``, in steps that become smaller. None with fewer than six pairs, or three of a class."""
    same = y == 1
    n, ones = len(y), int(same.sum())
    if n < 6 or min(ones, n - ones) < 3:
        return None
    mean = x.mean(axis=0)
    scale = np.maximum(x.std(axis=0, ddof=1), 1e-4)
    f = np.column_stack([np.ones(n), (x - mean) / scale])
    weight = np.where(same, n / (2 * ones), n / (2 * (n - ones)))
    w = np.array([np.log(ones / (n - ones)), 0.0, 0.0])
    held = ridge * np.array([0.0, 1.0, 1.0])
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        w = w - rate / np.sqrt(1 + step / 80) * (f.T @ ((p - y) * weight) / n + held * w)
    return Model(*map(float, w), float(mean[0]), float(scale[0]), float(mean[1]), float(scale[1]))


def merge_point(model: Model | None, different: np.ndarray) -> float:
    """From which probability pairs are merged: a margin over the likeliest of the labelled pairs of different people (rows of
    cosine and z)."""
    if model is None or not len(different):
        return MERGE
    return float(min(BOUNDS[1], max(BOUNDS[0], model(different[:, 0], different[:, 1]).max() + OVER)))
