"""SentencePiece: the library's own ids and texts, and the streaming search on its own."""

import random
from array import array

import public_tokenizers
import pytest
import sentencepiece

from colloquy.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab the ing\n\t  é中文ñß😀▁'s 0123tion   ́"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", " ", "  ", "x" * 5000, "the" * 2000, "▁▁ a", "\x00a", " " * 500, "aaaa" * 300]


@pytest.fixture(scope="module")
def both():
    return pieces.Model.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_are_the_librarys(both, texts):
    own, library = both
    for t in texts:
        assert own.encode(t) == library.encode(t)
        assert own.decode(library.encode(t)) == library.decode(library.encode(t))


def test_streaming_commits_before_the_end_and_gives_the_same_ids(both, texts):
    own, library = both
    for t in texts[-60:]:
        parts = list(own.stream(own.normalized(t)))
        assert [i for p in parts for i in p] == library.encode(t)
    assert len(list(own.stream(own.normalized("the report " * 300)))) > 300


def test_the_window_is_bounded_by_the_longest_piece(both):
    """Between two commits the search reads no more characters than a few pieces have, within words as across them."""
    own, library = both
    r = random.Random(6)
    for text in ("antidisestablishmentarianism" * 400, "".join(r.choice("abcdeinrst") for _ in range(20_000)), "the report of " * 2000, "é中😀" * 3000):
        read, pending, widest, ids = 0, 0, 0, []

        def chars(t):
            nonlocal read
            for c in t:
                read += 1
                yield c

        for part in own.stream(chars(own.normalized(text))):
            widest = max(widest, read - pending)
            pending = read
            ids += part
        assert ids == library.encode(text) and widest <= 8 * own.longest


def test_what_is_remembered_changes_nothing(both, texts):
    own, library = both
    for t in texts:
        fresh = pieces.Model.load(PATH) if len(t) < 3 else own
        assert fresh.packed(t) == own.packed(t)
        assert own.packed(t)[1] == (own.decode(own.encode(t)) == t)


def test_words_of_a_batch_are_searched_in_step(both, texts, monkeypatch):
    """New words of many texts take no search of their own, also where tables are small, and give the library's ids."""
    _, library = both
    r = random.Random(8)
    words = [" ".join("".join(r.choice(["the", "ing", "ñ", "é", "q", "ion", "x", ",", "7"]) for _ in range(r.randint(1, 8))) for _ in range(60)) for _ in range(40)]
    own = pieces.Model.load(PATH)
    with monkeypatch.context() as m:
        m.setattr(own, "stream", None)
        assert own.packed_all(words) == [(array("i", library.encode(t)).tobytes(), True) for t in words]
    for name, size in (("SLOTS", 4), ("IN_STEP", 3), ("LOOKED_UP", 5), ("KEEP_SEGMENTS", 50), ("KEEP_PAIRS", 7)):
        monkeypatch.setattr(pieces, name, size)
    small = pieces.Model.load(PATH)
    assert [x for x, _ in small.packed_all([*texts, *words])] == [array("i", library.encode(t)).tobytes() for t in [*texts, *words]]
    assert [ok for _, ok in small.packed_all(texts)] == [own.decode(own.encode(t)) == t for t in texts]


def test_pairs_are_stable_as_merging_says(both):
    own, _ = both
    r = random.Random(3)
    ids = [i for i in own.ids.values() if own.whole(i)]
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids[:2000])
        assert own.stable(a, b) == (own.merged(own.pieces[a][0] + own.pieces[b][0]) == [own.pieces[a][0], own.pieces[b][0]])


def test_unigram_models_take_the_path_of_the_greatest_sum():
    vocabulary = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("ba", -4.9, 1), ("bab", -4.0, 1), ("c", -6.0, 1)]
    own = pieces.Model(pieces.UNIGRAM, vocabulary, byte_fallback=False)

    def best(text):
        if not text:
            return 0.0
        return max(own.scores[own.ids[text[:n]]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in own.ids)

    r = random.Random(5)
    for _ in range(100):
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 10)))
        got = own.encode(text)
        assert "".join(vocabulary[i][0] for i in got) == own.normalized(text)
        assert sum(own.scores[i] for i in got) == pytest.approx(best(own.normalized(text)))


def test_operator(spark, both):
    _, library = both
    rows = [(1, "Hello  world\n", "x"), (1, "Hello  world\n", "x"), (None, None, None), (3, "", "y"), (4, "long " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(df, PATH, ["doc_id", "ids"])
    assert out.columns == ["doc_id", "ids", "_ids", "n_ids", "round_trip"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(a, c, None if t is None else library.encode(t), 0 if not t else len(library.encode(t)), None if t is None else True) for a, t, c in rows], key=str)
    back = pieces.decode(pieces.encode(df, PATH).where("doc_id = 1"), PATH)
    assert {r["text"] for r in back.collect()} == {"Hello  world\n"}
    odd = spark.createDataFrame([([1, 40_000],), ([],), (None,), ([-1],)], "ids array<int>")
    assert [r["text"] for r in pieces.decode(odd, PATH).collect()] == [None, "", None, None]
    assert pieces.encode(df.limit(0), PATH).count() == 0
