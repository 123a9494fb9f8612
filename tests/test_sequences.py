"""Edit distances of many pairs at a time against the table of one pair, and runs of characters against sets."""

import random

import numpy as np
import pytest

from colloquy import functions
from colloquy.functions import sequences
from colloquy.plans import procedures


def pairs():
    r = random.Random(5)
    out = []
    for _ in range(250):
        k = r.choice([2, 4, 30])
        a = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 128, 129, 300]))]
        b = list(a) if r.random() < 0.3 else [r.randrange(k) for _ in range(r.choice([0, 1, 3, 64, 65, 130, 400]))]
        for _ in range(r.randrange(6) if b else 0):
            b[r.randrange(len(b))] = r.randrange(k)
        out.append((a, b))
    return out


@pytest.mark.parametrize("wide", [16, 2, 0])
def test_edit_distances(monkeypatch, wide):
    monkeypatch.setattr(sequences, "WIDE", wide)
    monkeypatch.setattr(sequences, "AT_ONCE", 2000)
    a, b = ([np.array(x, dtype=np.int64) for x in side] for side in zip(*pairs(), strict=True))
    assert sequences.edit_distances(a, b).tolist() == [functions.edit_distance(x, y) for x, y in pairs()]
    assert sequences.edit_distances([], []).tolist() == []


def test_very_long_texts_take_a_step_for_many_cells():
    """As long as the longest lines of the tables: cell by cell this is 4 * 10^9 steps."""
    r = random.Random(1)
    a, b = (np.array([r.randrange(30) for _ in range(n)], dtype=np.int64) for n in (60_000, 70_000))
    assert 10_000 <= sequences.edit_distances([a], [b])[0] <= 70_000


def test_distances_of_columns(spark):
    rows = [("kitten sat", "sitting at"), ("", "abc"), (None, "x"), ("x", None), ("ÄÖ𝒳", "ao"), ("same", "same")]
    t = spark.createDataFrame(rows, "a string, b string").selectExpr("*", "levenshtein(a, b) AS want", "split(a, ' ') AS x", "split(b, ' ') AS y")
    got = t.select("want", functions.char_distance("a", "b").alias("got"), functions.word_distance("x", "y").alias("words")).collect()
    assert [r.got for r in got] == [r.want for r in got] and [r.words for r in got] == [2, 1, None, None, 1, 0]


@pytest.mark.parametrize("n", [2, 3])
def test_runs_of_characters(n):
    r = random.Random(n)
    for _ in range(50):
        a, b, c = ("".join(r.choice("ab𝒳é ") for _ in range(r.randrange(12))) for _ in range(3))
        of = lambda t: {t[i : i + n] for i in range(len(t) - n + 1)}
        x, y, z = (sequences.runs_of(t, n) for t in (a, b, c))
        assert len(x) == len(of(a)) and sequences.held(x, y, z) == len(of(a) & (of(b) | of(c)))


def test_pairs_of_all_lengths_go_side_by_side(monkeypatch):
    r = random.Random(8)
    a, b = ([np.array([r.randrange(20) for _ in range(r.randrange(1, 900))], dtype=np.int64) for _ in range(120)] for _ in range(2))
    calls, many = [], sequences._many
    monkeypatch.setattr(sequences, "_many", lambda *x: calls.append(len(x[0])) or many(*x))
    assert sequences.edit_distances(a, b).tolist() == [functions.edit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    assert len(calls) == 1


@pytest.mark.parametrize("cells", [1 << 20, 1])
@pytest.mark.parametrize("symbols", [(3, 1), (300, 7), (200, 2**31 // 200)])
def test_symbols_of_any_size(monkeypatch, cells, symbols):
    monkeypatch.setattr(sequences, "CELLS", cells)
    monkeypatch.setattr(sequences, "FEW", 0)
    monkeypatch.setattr(sequences, "LANES", 9)
    r = random.Random(9)
    a, b = ([np.array([r.randrange(symbols[0]) * symbols[1] for _ in range(r.choice([0, 1, 64, 65, 200, 300]))], dtype=np.int64) for _ in range(40)] for _ in range(2))
    b[3] = a[3]
    assert sequences.edit_distances(a, b).tolist() == [functions.edit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_words_and_characters_of_texts():
    texts = ["a b a", "", "b", "ÄÖ𝒳 a"]
    words = sequences.words_of(texts)
    assert [len(x) for x in words] == [3, 0, 1, 2] and words[0][0] == words[0][2] == words[3][1] and words[0][1] == words[2][0] != words[3][0]
    assert [x.tolist() for x in sequences.points_of(texts)] == [[ord(c) for c in t] for t in texts]
    assert [len(x) for x in sequences.words_of(["", ""])] == [0, 0] and sequences.words_of([]) == []


def test_errors_of_a_line_against_the_one_before(spark):
    said = ["The cat sat.", "the CAT, sat", "", "a cat", None, "x", "Été là"]
    lines = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(said)] + [(99, 2, 0, "alone")], "id long, recording_id long, utterance_index int, text string")
    got = {r.id: tuple(r)[1:] for r in procedures.word_errors(spark, {"text_lines": lines}).collect()}
    assert got == {1: (0, 3, 0, 11), 2: (3, 3, 11, 11), 3: (2, 0, 5, 0), 4: (None, 2, None, 5), 6: (2, 1, 6, 1)}
