import random

import public_tokenizers
from tokenizers import Tokenizer

from planarlake.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sample(n):
    rnd = random.Random(3)
    parts = [*"aab  \n\t'sthe éñ中文\x1c\x85\xa0 .!12½<|", "<|endoftext|>", "'ll", " the", "aaaa", "  "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    texts = [*sample(4000), "a" * 5000, "ab" * 3000, "", " ", "word " * 4000, "<|endoftext|>" * 3]
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    with open(PATH, "rb") as f:
        merger = T.RankMerger(f.read())
    got = []
    for i in range(0, len(texts), 300):
        got += merger.counts(texts[i : i + 300])
    assert got == want


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "the cat", 5), (3, "the cat", 5), (3, "the cat", 5), (4, "x y " * 600, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in T.token_counts(df, PATH).collect()), key=str)
    lib = Tokenizer.from_file(PATH)
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _ in rows]
    assert got == sorted(want, key=str)
    assert T.token_counts(df.limit(0), PATH).count() == 0
