"""Edit distances and common runs of characters of many pairs of texts at a time, for the batches of a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of 64 bits of a pattern up to which pairs go side by side; longer ones go one by one, as whole numbers of any length. So do the
#: pairs with the longest sides, as few wouldn't be worth a step of their own.
WIDE, FEW = 256, 24
#: Words of 64 bits that go side by side, about, and symbols of their pairs; cells of a table of the places of symbols, from which symbols are
#: numbered anew for each pair.
LANES, AT_ONCE, CELLS = 1 << 12, 1 << 21, 1 << 20


def edit_distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Insertions, deletions and replacements between a[i] and b[i], arrays of whole numbers from 0 to 2^31.

    Bit by bit (Myers 1999, in blocks as Hyyrö 2003): a column of the table is two bits for each symbol of the shorter side, 64 of which take
    one step. All blocks of all pairs go side by side, each a column behind the block before, whose last step it needs.
    """
    out = np.zeros(len(a), dtype=np.int64)
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if len(a) else ((), ())
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (short, long))
    out[m == 0] = n[m == 0]
    blocks = -(-m // 64)
    order = np.argsort(-n, kind="stable")
    order = order[m[order] > 0]
    alone = blocks[order] > WIDE
    alone[:FEW] = True
    for i in order[alone]:
        out[i] = _one(short[i].tolist(), long[i].tolist())
    order = order[~alone]
    lanes, symbols = np.cumsum(blocks[order]), np.cumsum(n[order])
    i = 0
    while i < len(order):
        before = (lanes[i - 1], symbols[i - 1]) if i else (0, 0)
        j = max(i + 1, min(int(np.searchsorted(lanes, before[0] + LANES, "right")), int(np.searchsorted(symbols, before[1] + AT_ONCE, "right"))))
        some = order[i:j]
        out[some] = _many([short[x] for x in some], [long[x] for x in some])
        i = j
    return out


def _many(short: list[np.ndarray], long: list[np.ndarray]) -> np.ndarray:
    """Distances of pairs, the longest of the longer sides first."""
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (short, long))
    blocks = -(-m // 64)
    pair = np.repeat(np.arange(len(m)), blocks)  # of each lane, which is a block of a pair
    first = np.cumsum(blocks) - blocks
    block = np.arange(len(pair)) - first[pair]
    own_m, own_n = (np.repeat(np.arange(len(m)), size) for size in (m, n))
    one_side, other = np.concatenate(short), np.concatenate(long)
    # Symbols by numbers from 1 (for each pair its own, where there are many); 0 for those that aren't in the shorter side.
    width = int(max(one_side.max(), other.max())) + 1
    if width > 1 << 21:
        known, both = np.unique(np.concatenate([one_side, other]), return_inverse=True)
        one_side, other, width = both[: len(one_side)], both[len(one_side) :], len(known)
    else:
        seen = np.zeros(width, dtype=bool)
        seen[one_side] = True
        number = np.where(seen, np.cumsum(seen) - 1, width := int(seen.sum()))
        one_side, other, width = number[one_side], number[other], width + 1
    if len(pair) * (width + 1) <= CELLS:
        one_side, other = one_side + 1, other + 1
        kinds = np.full(len(m), width + 1)
    else:
        key, asked = own_m * width + one_side, own_n * width + other
        known = np.unique(key)
        kinds = np.bincount(known // width, minlength=len(m)) + 1
        before = np.cumsum(kinds - 1) - (kinds - 1)
        one_side = np.searchsorted(known, key) - before[own_m] + 1
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        other = np.where(known[at] == asked, at - before[own_n] + 1, 0)
    # Where a symbol of a pair stands in each of its blocks.
    sizes = kinds[pair]
    base = np.cumsum(sizes) - sizes
    place = np.arange(len(one_side)) - np.repeat(np.cumsum(m) - m, m)
    equal = np.zeros(int(sizes.sum()), dtype=np.uint64)
    cell = base[first[own_m] + (place >> 6)] + one_side
    np.bitwise_or.at(equal, cell, np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)))
    # Before a pair's longer side as many symbols that are nowhere as it has blocks: a block waits there, unchanged, for the one before.
    ends = np.cumsum(n + blocks)
    padded = np.zeros(int(ends[-1]) + int(blocks.max()) + int(n[0]) + 1, dtype=np.int64)
    start = ends - n
    padded[np.arange(len(other)) + np.repeat(start - (np.cumsum(n) - n), n)] = other
    at = start[pair] - block
    steps = (n + blocks - 1)[pair]
    # As n falls, lanes that still run are the first ones but for some of the last blocks; those that have ended do no harm.
    least = np.maximum.accumulate(steps[::-1])[::-1]
    last = first + blocks - 1
    bit = ((m - 1) & 63).astype(np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), dtype=np.uint64)
    more, less = np.zeros(len(pair), dtype=np.uint64), np.zeros(len(pair), dtype=np.uint64)  # what comes in from the block before
    more[first] = one
    score = m.copy()
    k = len(pair)
    for t in range(int(least[0])):
        while k and least[k - 1] <= t:
            k = int(np.searchsorted(-least, -t, "left"))
        eq = equal[base[:k] + padded[at[:k] + t]]
        pv, mv = up[:k], down[:k]
        xv = eq | mv
        eq |= less[:k]
        xh = eq & pv
        xh += pv
        xh ^= pv
        xh |= eq
        ph = xh | pv
        np.invert(ph, out=ph)
        ph |= mv
        mh = pv & xh
        # The pairs whose last block is at a symbol of theirs.
        p = int(np.searchsorted(last, k, "left"))
        now = (t >= blocks[:p] - 1) & (t < n[:p] + blocks[:p] - 1)
        score[:p] += now * ((ph[last[:p]] >> bit[:p] & one).astype(np.int64) - (mh[last[:p]] >> bit[:p] & one).astype(np.int64))
        next_more, next_less = ph >> top, mh >> top
        ph <<= one
        ph |= more[:k]
        mh <<= one
        mh |= less[:k]
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
        more[1:k], less[1:k] = next_more[: k - 1], next_less[: k - 1]
        more[first[:p]], less[first[:p]] = one, 0
    return score


def _one(short: list, long: list) -> int:
    """The same for one pair, with a number of as many bits as the shorter side has symbols."""
    m = len(short)
    whole, top = (1 << m) - 1, m - 1
    places: dict = {}
    for i, v in enumerate(short):
        places.setdefault(v, []).append(i)
    equal = {}
    for v, at in places.items():
        bits = np.zeros(m, dtype=np.uint8)
        bits[at] = 1
        equal[v] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    pv, mv, score = whole, 0, m
    for v in long:
        eq = equal.get(v, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & whole), pv & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        ph, mh = (ph << 1 | 1) & whole, (mh << 1) & whole
        pv, mv = mh | (~(xv | ph) & whole), ph & xv
    return score


def coded(texts: list[list[str]]) -> list[np.ndarray]:
    """Lists of words as numbers, equal words alike."""
    code: dict = {}
    return [np.array([code.setdefault(w, len(code)) for w in t], dtype=np.int64) for t in texts]


def words_of(texts: list[str]) -> list[np.ndarray]:
    """The words of texts, with a space between them, as numbers, equal words alike."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    number = pc.dictionary_encode(words.values).indices.to_numpy().astype(np.int64)
    ends = words.offsets.to_numpy()
    return [number[a:b] if t else number[:0] for t, a, b in zip(texts, ends, ends[1:], strict=False)]


def points_of(texts: list[str]) -> list[np.ndarray]:
    ends = np.cumsum([0, *map(len, texts)])
    c = points("".join(texts))
    return [c[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def runs_of(text: str, n: int) -> np.ndarray:
    """The different runs of n characters (3 at most) of a text as numbers, sorted."""
    c = points(text)
    code = c[: max(0, len(c) - n + 1)].copy()
    for k in range(1, n):
        code = code << 21 | c[k : len(c) - n + 1 + k] if len(code) else code
    code.sort()
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


def held(mine: np.ndarray, *others: np.ndarray) -> int:
    """How many of ``mine`` are in one of ``others``, all sorted."""
    found = np.zeros(len(mine), dtype=bool)
    for x in others:
        if len(x) and len(mine):
            found |= x[np.minimum(np.searchsorted(x, mine), len(x) - 1)] == mine
    return int(found.sum())
