import random

import public_tokenizers
from tokenizers import Tokenizer

from colloquy.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_librarys_for_whole_texts(spark, sf_dir):
    r = random.Random(2)
    alphabet = ["<|endoftext|>", "<|startoftext|>", "a", "B", "'s", "'re", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "́", "é", "Σ", "ς", "İ", "ǅ", "中", "12", "😀", "-", "..."]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 40_000), (None, "a b"), (902, "x" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60))
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(x.doc_id), len((x.text or "").encode()), n := len(tok.encode(x.text or "", add_special_tokens=False).ids), n > 2048) for x in df.collect())
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.count_tokens(df, PATH).collect())
    assert got == want
    wide = df.selectExpr("*", "1 AS n_tokens", "2 AS row", "3 AS w")
    assert sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.count_by_join(wide, PATH).collect()) == want
    assert tokens.count_tokens(wide, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
