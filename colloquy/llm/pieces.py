"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read character by character. Every boundary keeps one backpointer: the piece that ends there on the best
path. Only boundaries from which a piece is still under way can be reached again, none further back than the longest
piece; when the backpointer paths of all of them meet in one boundary, everything before it is final and its ids are
committed. Memory depends on the longest piece, not on the text. All texts, of any length, go through this search; words that a
worker sees for the first time go through it side by side, a character further at each step (``Steps``).

What "best" means depends on the model:

* unigram: the greatest sum of piece scores, the textbook recurrence.
* bpe: merging by rank has exactly one outcome for a prefix, and a sequence of pieces is that outcome if and only if
  every two neighbours are (merging the two pieces' characters gives back the two pieces). So the lattice has an edge
  from one piece to the next only if that pair is stable, and at each boundary one piece remains.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Stretches and pairs of pieces that a worker remembers (about 80 MB and 40 MB); then the tables start anew. Stretches of
#: more characters aren't remembered.
KEEP_SEGMENTS, KEEP_PAIRS, REMEMBERED = 400_000, 400_000, 32
#: Characters of texts that are packed together, stretches that are looked up and that are searched in step, slots of the table of
#: pairs beside those (18 MB).
TOGETHER, LOOKED_UP, IN_STEP, SLOTS = 1 << 20, 1 << 17, 1 << 14, 1 << 21
FAR = float("inf")


class Model:
    """What encoding and decoding need of a SentencePiece model file."""

    def __init__(self, kind: int, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True, byte_fallback: bool = True, strip: bool = False):
        self.kind, self.dummy_prefix, self.byte_fallback, self.strip = kind, dummy_prefix, byte_fallback, strip
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        #: No piece goes over the start of a word: all paths meet there, and a word's ids depend on the word alone.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # A character that no longer piece holds is a path's only way, so it ends a segment as well.
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.joined)
        self.segment = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+") if lone else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.stable_pairs: dict[int, bool] = {}
        self.trie: dict | None = None
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.unordered: set[int] = set()
        self.known: dict[str, bytes] = {}
        self.steps: Steps | None = None
        self.shown = [b"" if t == CONTROL else (" ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()) for p, _, t in pieces]
        self.text_of = [x.decode() if t != BYTE else "" for x, (_, _, t) in zip(self.shown, pieces, strict=True)]
        self.byte_ids = frozenset(self.bytes.values())

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap:
            raise ValueError("models with a character map aren't supported: normalise the text first")
        return cls(m.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in m.pieces], n.add_dummy_prefix, m.trainer_spec.byte_fallback, n.remove_extra_whitespaces)

    def normalized(self, text: str) -> str:
        if self.strip:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def missing(self, char: str) -> tuple[int, ...]:
        if self.byte_fallback and self.bytes:
            return tuple(self.bytes[b] for b in char.encode("utf-8", "replace"))
        return (self.unknown,)

    def merged(self, text: str) -> list[str]:
        """Merging by rank, directly; for a few characters."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _grow(self, piece: int) -> None:
        """How merging builds a piece: the parts at its left and at its right edge, each with the rank that made it."""
        parts, ranks = [(c, ()) for c in self.pieces[piece][0]], self.ranks
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i][0] + parts[i + 1][0], FAR))
            (a, x), (b, y) = parts[at : at + 2]
            if ranks.get(a + b, FAR) == FAR:
                self.edges[piece] = None
                return
            if max(ranks.get(a, -FAR) if len(a) > 1 else -FAR, ranks.get(b, -FAR) if len(b) > 1 else -FAR) >= ranks[a + b]:
                self.unordered.add(piece)
            parts[at : at + 2] = [(a + b, ((a, x), (b, y)))]
        sides = []
        for side in (0, 1):
            node, found = parts[0], []
            while True:
                found.append((node[0], ranks[node[0]] if len(node[0]) > 1 else -FAR))
                if not node[1]:
                    break
                node = node[1][side]
            sides.append(found[::-1])
        self.edges[piece] = (sides[0], sides[1])

    def whole(self, piece: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        if piece not in self.edges:
            self._grow(piece)
        return self.edges[piece] is not None

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives the two pieces.

        Merges happen in the order of their ranks if no part of a piece ranks after it (a piece of which this isn't so
        is in ``unordered``, and then the characters are merged outright). So walk along the right edge of ``left`` and the left edge of ``right``:
        a merge across comes about if it ranks before the next merge on either side; at equal rank the left one goes first.
        """
        key = left * len(self.pieces) + right
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) > KEEP_PAIRS:
                self.stable_pairs.clear()
            known = self.stable_pairs[key] = self._walk(self.edges[left][1], self.edges[right][0]) if self.unordered.isdisjoint((left, right)) else self.merged(self.pieces[left][0] + self.pieces[right][0]) == [self.pieces[left][0], self.pieces[right][0]]
        return known

    def _walk(self, a: list[tuple[str, float]], b: list[tuple[str, float]]) -> bool:
        i, j, ranks = 0, 0, self.ranks
        while True:
            next_a = a[i + 1][1] if i + 1 < len(a) else FAR
            next_b = b[j + 1][1] if j + 1 < len(b) else FAR
            across = ranks.get(a[i][0] + b[j][0], FAR)
            if across < next_a and across <= next_b and across < FAR:
                return False
            if next_a == next_b == FAR:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Committed ids of a normalised text, commit by commit. ``blocks``: the text in pieces of any length.

        Boundaries are taken in order. From each that a path reaches, the tree of pieces is walked over the characters
        ahead (as many as the longest piece has), and the pieces found are put where they end. ``reach`` is the last
        boundary that any path has come to: if it is the current one, all paths meet here.
        """
        top, ids, scores, pairs, size, longest, stable = self.trie or self._grown(), self.ids, self.scores, self.stable_pairs, len(self.pieces), self.longest, self.stable
        bpe, it, more = self.kind == BPE, iter(blocks), True
        window, n, start, done, reach, check = "", 0, 0, 0, 0, 4 * longest
        # For each boundary: the piece that ends there (-1: no path, -2: an unknown character or the start of the text),
        # where that piece starts, and the path's score.
        last, back, best = [-2], [0], [0.0]
        while True:
            while more and n - start < longest:
                block = next(it, None)
                if block is None:
                    more = False
                else:
                    window, k = window + block, len(block)
                    n += k
                    last += [-1] * k
                    back += [0] * k
                    best += [0.0] * k
            if start == reach:
                if start > done:
                    yield self._trace(window, last, back, done, start)
                    done = start
                if start == n:
                    return
            elif start >= check:
                # Paths run side by side: where do those that can still be reached meet?
                live = {e for e in range(start, reach + 1) if last[e] != -1}
                while len(live) > 1:
                    latest = max(live)
                    live.remove(latest)
                    live.add(back[latest])
                if (meet := live.pop()) > done:
                    yield self._trace(window, last, back, done, meet)
                    done = meet
                check = start + longest
            if done >= 4 * longest:
                window, last, best, back = window[done:], last[done:], best[done:], [x - done for x in back[done:]]
                n, start, reach, check, done = n - done, start - done, reach - done, check - done, 0
            left = last[start]
            if left != -1:
                at, end, row, score = top, start, left * size, best[start]
                while end < n and (node := at.get(window[end])):
                    at, piece = node
                    end += 1
                    if piece >= 0:
                        if bpe:
                            if left >= 0:
                                ok = pairs.get(row + piece)
                                if not (stable(left, piece) if ok is None else ok):
                                    continue
                        elif last[end] != -1 and best[end] >= score + scores[piece]:
                            continue
                        else:
                            best[end] = score + scores[piece]
                        last[end], back[end] = piece, start
                        if end > reach:
                            reach = end
                if window[start] not in ids and (last[start + 1] == -1 or (not bpe and best[start + 1] < score + self.unknown_score)):
                    # No piece is this character: it stands alone, at a cost in a unigram model.
                    last[start + 1], back[start + 1], best[start + 1] = -2, start, score + self.unknown_score
                    reach = max(reach, start + 1)
            start += 1

    def _trace(self, window: str, last: list[int], back: list[int], start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out += self.missing(window[end - 1])[::-1]
            end = back[end]
        return out[::-1]

    def _grown(self) -> dict:
        """A tree of the pieces by character: char -> (what follows, the piece that ends here or -1)."""
        top: dict = {}
        for text, i in self.ids.items():
            at, node = top, None
            for c in text:
                node = at.setdefault(c, [{}, -1])
                at = node[0]
            if self.kind != BPE or self.whole(i):
                node[1] = i
        self.trie = top
        return top

    def stretches(self, text: str) -> list[str]:
        """A text cut where all paths meet, whatever they are: before a word, if no piece goes over its start."""
        normal = self.normalized(text)
        return self.segment.findall(normal) if self.by_word else [normal] if normal else []

    def packed(self, text: str) -> tuple[bytes, bool]:
        """The ids of a text, 32 bits each, and whether decoding them gives it again."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """The same of each of some texts. Decoding goes by stretches too: each is whole characters."""
        split = [self.stretches(t) for t in texts]
        flat = list(chain.from_iterable(split))
        found, odd = [], []
        for i in range(0, len(flat), LOOKED_UP):
            ids, others = self._found(flat[i : i + LOOKED_UP])
            found += ids
            odd += [i + k for k in others]
        out, a = [], 0
        for text, parts in zip(texts, split, strict=True):
            b = a + len(parts)
            good = MARK not in text and not (self.strip and self.normalized(text) != MARK * self.dummy_prefix + text.replace(" ", MARK))
            out.append((b"".join(found[a:b]), good and bisect_left(odd, a) == bisect_left(odd, b)))
            a = b
        return out

    def _found(self, some: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of stretches, and the places of those that don't decode to themselves.

        What the search commits for a stretch depends on the stretch alone, so it is remembered, if it is short, and those that
        aren't known yet are searched together.
        """
        found, odd = list(map(self.known.get, some)), []
        lacking = list(compress(range(len(some)), map(is_, found, repeat(None))))
        new = self._searched(list(dict.fromkeys([some[i] for i in lacking])))
        for i in lacking:
            found[i], same = new[some[i]]
            if not same:
                odd.append(i)
        if len(self.known) + len(new) > KEEP_SEGMENTS:
            self.known.clear()
        self.known.update({s: ids for s, (ids, same) in new.items() if same and len(s) <= REMEMBERED})
        return found, odd

    def _searched(self, stretches: list[str]) -> dict[str, tuple[bytes, bool]]:
        """Ids of each, and whether they decode to it. Short ones go through the search in step, if the model is of merges."""
        out: dict[str, tuple[bytes, bool]] = {}
        if self.kind == BPE and len(stretches) > 1:
            self.steps = self.steps or Steps(self)
            # Of pieces alone, which are the stretch's own characters, so they decode to it.
            out = {s: (ids, True) for s, ids in self.steps.search([s for s in stretches if len(s) <= REMEMBERED])}
        for s in stretches:
            if s not in out:
                ids = [x for part in self.stream([s] if len(s) <= REMEMBERED else _blocks(s, self.longest)) for x in part]
                out[s] = array("i", ids).tobytes(), self._shown(ids) == s.replace(MARK, " ")
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return array("i", self.packed(text)[0]).tolist()

    def _shown(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if self.byte_ids.isdisjoint(ids):
            return "".join(map(self.text_of.__getitem__, ids))
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. The space that encoding put first is dropped."""
        text = self._shown(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Steps:
    """The search over many short stretches of a model of merges, all of them a character further at each step.

    The lattice, its stable pairs and backpointers are those of ``Model.stream``, from the other end: at each boundary the
    tree of pieces is walked back over the characters before it, until the piece is met that the path to where it starts
    may go on with. As just one piece remains at a boundary, the first is the one.
    """

    def __init__(self, model: Model):
        self.model = model
        alone = sorted(c for c in model.ids if len(c) == 1)
        self.kinds = np.zeros(0x110000, np.int32)  # by character: its number, 0 if no piece is this character
        self.kinds[[ord(c) for c in alone]] = np.arange(1, len(alone) + 1)
        number, self.width = {c: i for i, c in enumerate(alone, 1)}, len(alone) + 1
        nodes, ends = {}, [-1]
        for text, i in model.ids.items():
            if not model.whole(i) or not all(map(number.__contains__, text)):
                continue
            at = 0
            for c in reversed(text):
                key = at * self.width + number[c]
                if (at := nodes.get(key)) is None:
                    at = nodes[key] = len(ends)
                    ends.append(-1)
            ends[at] = i
        self.keys = np.array(sorted(nodes), np.int64)
        self.nodes = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.pieces = np.array(ends, np.int64)
        self.pairs, self.ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def search(self, stretches: list[str]) -> Iterator[tuple[str, bytes]]:
        """Stretches, not empty, whose characters are all pieces, each with its ids."""
        order = sorted(stretches, key=len, reverse=True)
        for i in range(0, len(order), IN_STEP):
            some = order[i : i + IN_STEP]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            kinds = self.kinds[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
            have = np.minimum.reduceat(kinds, np.cumsum(sizes) - sizes) > 0
            if have.any():
                yield from self._in_step(list(compress(some, have.tolist())), sizes[have], kinds[np.repeat(have, sizes)])

    def _in_step(self, some: list[str], sizes: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[str, bytes]]:
        n, most = len(some), int(sizes[0])  # longest first: those that go on are the first ones
        chars = np.zeros((n, most), np.int64)
        chars[np.arange(most) < sizes[:, None]] = kinds
        chars = np.ascontiguousarray(chars.T)
        # At each boundary of each stretch: the piece that ends there, where it starts, how many pieces that makes.
        last, back, count = np.full((most + 1, n), -2, np.int64), np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), np.int64)
        goes_on = np.searchsorted(-sizes, -np.arange(most), "left")
        for at in range(most):
            rows = np.arange(goes_on[at])
            node = np.zeros(len(rows), np.int64)
            for start in range(at, -1, -1):
                key = node * self.width + chars[start][rows]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                node = np.where(self.keys[place] == key, self.nodes[place], 0)
                piece, left = self.pieces[node], last[start][rows]
                ends = np.flatnonzero(piece >= 0)
                ends = ends[self._stable(left[ends], piece[ends])]
                won = rows[ends]
                last[at + 1][won], back[at + 1][won], count[at + 1][won] = piece[ends], start, count[start][won] + 1
                node[ends] = 0
                keep = node > 0
                rows, node = rows[keep], node[keep]
                if not len(rows):
                    break
        rows, at = np.arange(n), sizes
        counts = count[at, rows]
        upto = np.cumsum(counts)
        ids, place = np.empty(upto[-1], np.int32), upto - 1
        while len(rows):
            ids[place[rows]] = last[at, rows]
            place[rows] -= 1
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        packed, cuts = ids.tobytes(), (4 * upto).tolist()
        return zip(some, (packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True)

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each two pieces, whether they are stable; a piece at the start of a stretch is. Pairs that were asked for are in a table
        with a slot for each hash, so its size is fixed."""
        key = left * len(self.model.pieces) + right
        slot = (key * 0x9E3779B1 >> 7) & (SLOTS - 1)
        new = np.flatnonzero((left >= 0) & (self.pairs[slot] != key))
        out = self.ok[slot] | (left < 0)
        if len(new):
            asked, which = np.unique(key[new], return_inverse=True)
            answers = np.array([self.model.stable(*divmod(k, len(self.model.pieces))) for k in asked.tolist()], bool)
            out[new] = answers[which]
            # Of keys that share a slot one stays, with its own answer.
            slots, one = np.unique((asked * 0x9E3779B1 >> 7) & (SLOTS - 1), return_index=True)
            self.pairs[slots], self.ok[slots] = asked[one], answers[one]
        return out


def _blocks(text: str, size: int) -> Iterator[str]:
    return (text[i : i + size] for i in range(0, len(text), size))


def _together(texts: list[str]) -> Iterator[list[str]]:
    """Texts that follow each other, of about as many characters, a text at least."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t) > TOGETHER:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


_LOADED: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Model.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default), ids array<int>, n_ids long, round_trip boolean.

    The ids are those of the sentencepiece library for the same model, without begin and end. round_trip: decoding the
    ids gives the text again. Null text has null ids, n_ids 0 and null round_trip; empty text has no ids. Texts of any
    length are encoded whole in bounded memory besides their ids; repeated rows each; names in ``keep`` that clash with
    those made are kept, and the made ones get leading underscores.
    """
    keep = ["doc_id"] if keep is None else keep
    made = [fresh(keep, x) for x in ("ids", "n_ids", "round_trip")]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                texts = batch.column(n).to_pylist()
                got = [x for some in _together([t or "" for t in texts]) for x in m.packed_all(some)]
                flat = np.frombuffer(b"".join(x for x, _ in got), np.int32)
                counts = np.array([len(x) // 4 for x, _ in got], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([t is None for t in texts]))
                same = [None if t is None else ok for t, (_, ok) in zip(texts, got, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists, pa.array(counts), pa.array(same, pa.bool_())], [*(f"c{j}" for j in range(n)), "ids", "n_ids", "round_trip"])

    few = docs.select(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(keep)], F.col("text").alias("t"))
    kinds = ", ".join(f"c{j} {few.schema[j].dataType.simpleString()}" for j in range(n))
    out = few.mapInArrow(run, f"{kinds}, ids array<int>, n_ids bigint, round_trip boolean")
    return out.toDF(*keep, *made)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows of ``encoded`` with a column ``text``: the text of ``ids``. Null ids, and ids that the model doesn't have, give
    null; no ids give an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(column):
        m = model(path)
        return column.map(lambda x: None if x is None or any(i is None or not 0 <= i < len(m.pieces) for i in x) else m.decode(x))

    return encoded.withColumn(fresh(encoded.columns, text), run(F.col(ids)))
