import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from planarlake.llm import common as C
from planarlake.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sample(n):
    rnd = random.Random(5)
    parts = [*"aab  \n\t'sthe éñ中文\x1c\x85\xa0 　 .!12½<|", "<|endoftext|>", "'ll", " the", "aaaa", "  ", "　\n", "\xa0  x"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library():
    texts = [*sample(4000), "a" * 5000, "ab " * 3000, "", None, " ", "<|endoftext|>" * 3, "x <|endoftext|> y"]
    lib = Tokenizer.from_file(PATH)
    coder = P.Encoder(open(PATH, encoding="utf-8").read(), 2)
    for i in range(0, len(texts), 300):
        some = texts[i : i + 300]
        flat, at = coder.ids(pa.array(some, pa.string()))
        want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in some]
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_forgetting_changes_nothing(monkeypatch):
    texts = pa.array(sample(600), pa.string())
    whole = P.Encoder(open(PATH, encoding="utf-8").read(), 2).ids(texts)[0]
    monkeypatch.setattr(P, "MEMORY", 50)
    coder = P.Encoder(open(PATH, encoding="utf-8").read(), 2)
    got = [coder.ids(texts.slice(i, 100))[0] for i in range(0, 600, 100)]
    assert np.concatenate(got).tolist() == whole.tolist()


def check_plan(counts, capacity):
    plan, used = P.planned(counts, capacity), Counter()
    for m, what in plan:
        assert m > 0 and sum(k * t for k, t in what) <= capacity
        assert sum(t for k, t in what if 3 * k > capacity) <= 2
        for k, t in what:
            used[k] += m * t
    assert used == Counter({k: n for k, n in counts.items() if n})
    return sum(m for m, _ in plan)


def fewest(items, capacity):
    """By trying everything."""
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in sorted(set(range(len(bins))), key=lambda j: bins[j]):
            if bins[j] + items[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plan():
    rnd = random.Random(1)
    over = 0
    for _ in range(150):
        items = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 9))]
        got, want = check_plan(Counter(items), 12), fewest(items, 12)
        assert want <= got <= max(want, 11 * want // 9 + 1)
        over += got - want
    assert over <= 3
    big = {k: rnd.randint(0, 10**9) for k in range(1, 1025)}
    assert check_plan(big, 1024) <= 1.02 * max(sum(k * n for k, n in big.items()) / 1024, sum(n for k, n in big.items() if 2 * k > 1024))
    assert check_plan({7: 5}, 1024) == 1 and check_plan({}, 1024) == 0 and check_plan({512: 3}, 1024) == 2


def test_query(spark, tmp_path):
    """Against the library: every id stands once, in its document's order, and sequences have neither gaps nor too much."""
    rnd = random.Random(2)
    texts = sample(120) + ["word salad, " * rnd.randint(1, 900) for _ in range(60)] + [None, None, "", "a" * 9000, "same text"] + ["same text"] * 20
    rows = [(None if i % 40 == 7 else i // 2, t, 7, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, length int, part string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op11_best_fit_packing(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        assert edges[-1] == len(ids)
        want.update((d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(held) <= total // 1024 + 2
    assert sorted(held) == list(range(len(held)))


def test_sequences(spark):
    rows = [(i, "one two three " * (i % 50)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = C.staged(P.token_pieces(df, PATH, 128, keep_ids=True), "pieces")
    placed = P.packed(pieces, 128)
    lib = Tokenizer.from_file(PATH)
    ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    seqs = {r.sequence_id: r for r in P.sequences(placed).collect()}
    for r in placed.collect():
        s = seqs[r.sequence_id]
        assert s.ids[r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length] and r.offset in s.starts
    assert sum(len(s.ids) for s in seqs.values()) == sum(map(len, ids.values()))



def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op11_best_fit_packing(spark, str(tmp_path)).count() == 0
