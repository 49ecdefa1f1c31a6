import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from planarlake.llm import lm as L


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = tokens(t)
        out.append((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(out)


def run(spark, rows):
    from planarlake.llm import common as C

    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int")
    out = L.lm_scores(df, C.crc_mod(F.col("doc_id"), 5)).collect()
    assert all(r.score <= 0 and r.bits_per_byte >= 0 and np.isfinite(r.score) for r in out)
    return sorted((str(r.doc_id), r.fold == 1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)


def test_base_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(900, None), (901, ""), (None, "The\x0bend É"), (3, docs[3].text), (902, "z" * 5000 + " a" * 3000)]
    assert run(spark, rows) == brute(rows)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, f"a b{i}") for i in held]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_bits_sum_to_one_and_learning_helps():
    rng = np.random.default_rng(1)
    n = 1 << 18
    slots, bits = L.slots_of(L.grams_of([b"banana", b"bandana", b"nab"] * 9)[0], 18)
    n0, n1 = np.zeros(n), np.zeros(n)
    np.add.at(n1, slots[bits == 1].ravel(), 1.0)
    np.add.at(n0, slots[bits == 0].ravel(), 1.0)
    mixer = L.Mixer(L.Tables(n0, n1), L.start_weights() + rng.normal(0, 0.1, (L.GATES, L.ORDERS + 1)))
    context = int.from_bytes(b"  ban", "big") << 8
    assert abs(np.exp2(mixer.log2(context + np.arange(256))).sum() - 1) < 1e-6
    gram, _ = L.grams_of([b"banana", b"nab"] * 50)
    before = mixer.log2(gram).sum()
    mixer.learn(gram, np.ones(len(gram)), np.repeat(np.eye(L.ORDERS + 1)[None] * 4.0, L.GATES, 0))
    assert mixer.log2(gram).sum() > before


def test_model_beats_spelling_without_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = L.op2_lm_scoring(spark, "/root/testdata/sf0.001").where("held_out").agg(F.avg("bits_per_byte").alias("x")).first()
    text = "".join(x.text for x in docs.select("text").collect()).encode()
    p = np.bincount(np.frombuffer(text, np.uint8)) / len(text)
    assert r.x < -(p[p > 0] * np.log2(p[p > 0])).sum() * 0.75


def bucket(n):
    return min(1 + int(2 * math.log2(n)), 31) if n else 0


def brute_word(past, outcomes, w, count, code, spelt, chooser, total, ahead=(-1, 0, 0)):
    """(probability, outcomes by decision) of a word after the words of its text, by the definition."""
    place, best, length = len(past), None, 0
    for j in range(place - 1, 2, -1):  # the last place that the same three words went before
        if past[j - 3 : j] == past[place - 3 : place]:
            best = j
            break
    outcomes = [list(o) for o in outcomes]
    far, was = bucket(place), Counter(past)
    if best is not None:
        at = place
        while length < 15:  # matches on end, each with the one before it
            length += 1
            at -= 1
            prev = next((j for j in range(at - 1, 2, -1) if past[j - 3 : j] == past[at - 3 : at]), None) if at >= 3 else None
            if prev is None or prev != best - length:
                break
    hashed = int(L.W.mixed(np.array([code[past[-1]] if past else 0], np.uint64))[0] >> np.uint64(50))
    firsts = len(was)
    old = sum(count[x] > 0 for x in was)
    ratio, share = firsts * 15 // max(place, 1), old * 15 // max(firsts, 1)
    last_often, last_was = (bucket(count[past[-1]]), min(past[:-1].count(past[-1]), 7)) if past else (0, 0)

    logit = lambda yes, every: min(8, max(-8, math.log((yes + 1e-9) / max(every - yes, 1e-9))))
    part = lambda x: count[x] / total

    def decide(k, contexts, gate, bit, odds):
        history = sum((b + 1) * 3**j for j, b in enumerate(reversed(outcomes[k][-4:])))
        contexts[1] = history
        slots = np.array([[x + L.SLOTS * (L.CONTEXTS * k + j) for j, x in enumerate(contexts)]])
        p = chooser.yes(k, slots, np.array([gate]), np.array([[logit(*odds(m, j)) for j, m in enumerate(L.PRIORS)]]))[0]
        outcomes[k].append(int(bit))
        return p if bit else 1 - p

    p, cand = 1.0, past[best] if best is not None else None
    gate, ago, often = length, length, 0
    if cand is None and ahead[0] != -1:
        cand, gate, ago, often = ahead[0], 0, 16 + ahead[1], bucket(ahead[2])
    known_cand = cand is not None and cand >= 0
    seen = was[cand] if known_cand else 0
    if cand is not None:
        chance = part(cand) if known_cand else 0.0
        p *= decide(L.FOLLOWS, [ago, 0, min(seen, 7) * 32 + (bucket(count[cand]) if known_cand else 0), far, hashed, often * 256 + ago * 8 + min(seen, 7)], gate, w == cand, lambda m, j: (seen + m * chance, place + m))
        if w == cand:
            return p, outcomes
    gone = part(cand) if known_cand else 0.0
    there = sum(part(x) for x in was if x != cand)
    if place - seen > 0:
        # How often the word before stood earlier, as the word's own recency does.
        p *= decide(L.RECALLED, [far, 0, last_was * 32 + far, hashed, ratio * 32 + far, last_often * 8 + last_was], far // 2, w in was, lambda m, j: (place - seen + m * there, place - seen + m * (1 - gone)))
        if w in was:
            return p * (was[w] + chooser.weight * part(w)) / (place - seen + chooser.weight * there), outcomes
    p *= decide(L.KNOWN, [far, 0, share * 32 + far, hashed, last_often * 8 + last_was, ratio * 16 + share], far // 2, count[w] > 0, lambda m, j: (old + 0.8 * 4**j, firsts + 4**j))
    if count[w] > 0:
        return p * count[w] / total / (1 - sum(count[x] / total for x in {*was, cand if known_cand else w} - ({w} if not known_cand else set()))), outcomes
    return p * spelt[w] / (1 - sum(spelt[x] for x in was if not count[x])), outcomes


def test_words_cost_what_the_definition_says_and_share_out_all_probability():
    rng = np.random.default_rng(5)
    v = 12
    count = np.array([30, 20, 9, 5, 3, 2, 1, 1, 0, 0, 0, 0])
    total, code = int(count.sum()), rng.integers(0, 1 << 63, v).astype(np.uint64)
    spelt = np.where(count == 0, rng.random(v), 0.0)
    spelt /= spelt.sum()
    chooser = L.Chooser()
    chooser.n = rng.integers(0, 9, chooser.n.shape).astype(float)
    chooser.weights = chooser.weights + rng.normal(0, 0.2, chooser.weights.shape)
    chooser.hit = rng.integers(0, 30, chooser.hit.shape).astype(float)
    chooser.gain = rng.random(len(L.WEIGHTS))
    with np.errstate(divide="ignore"):
        logs = np.log(spelt)
    texts = [[0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 4, 8, 8], [5], [9, 9, 9, 9, 9, 9, 0], list(rng.integers(0, 10, 60)), [1, 2, 3, 4] * 6 + [11]]
    texts = [[int(x) for x in t] for t in texts]
    flat, size = np.array([x for t in texts for x in t]), np.array([len(t) for t in texts])
    # What the corpus foresees, right or wrong, also words that aren't here; known words only.
    told = np.where(rng.random(len(flat)) < 0.5, -1, np.where((rng.random(len(flat)) < 0.5) & (count[flat] > 0), flat, rng.integers(0, 8, len(flat))))
    told[rng.random(len(flat)) < 0.1] = -2
    ahead = told, rng.integers(0, L.AHEAD, len(flat)), rng.integers(2, 50, len(flat))
    got = L.word_logs(L.Steps(flat, size, count, code, total, ahead), chooser, flat, logs, total)
    at = 0
    for t in texts:
        outcomes = [[], [], []]
        for i, w in enumerate(t):
            p = [brute_word(t[:i], outcomes, x, count, code, spelt, chooser, total, [a[at] for a in ahead]) for x in range(v)]
            assert abs(np.exp(got[at]) - p[w][0]) < 1e-9 * max(1e-3, p[w][0]) + 1e-12
            # What is kept for a kind of word of which none is left, or for a word that isn't here, goes unused.
            left = [any(x not in [*t[:i], told[at]] for x in kind) for kind in (range(8), range(8, v))]
            assert sum(x for x, _ in p) < 1 + 1e-6 and (not all(left) or told[at] == -2 or abs(sum(x for x, _ in p) - 1) < 1e-6)
            outcomes = p[w][1]
            at += 1


def test_deciding_is_learned():
    rng = np.random.default_rng(7)
    count, code = np.array([50] * 20 + [0] * 200), rng.integers(0, 1 << 63, 220).astype(np.uint64)
    chooser, info = L.Chooser(), np.tile(np.eye(L.INPUTS) * 4.0, (3, L.GATES, 1, 1))
    make = lambda: np.concatenate([np.tile(rng.integers(0, 220, 9), 4) for _ in range(20)])
    spelt = np.full(220, -np.log(200.0))
    test = make()
    cost = lambda: L.word_logs(L.Steps(test, np.array([len(test)]), count, code, 1000), chooser, test, spelt, 1000).sum()
    before = cost()
    for _ in range(10):
        x = make()
        chooser.learn(L.Steps(x, np.array([len(x)]), count, code, 1000), info)
    after = cost()
    assert after > before * 0.8
    merged = L.Chooser()
    merged.merge(*chooser.learned(info))
    chooser, old = merged, chooser
    assert np.allclose(merged.weights[info.any((2, 3))], old.weights[info.any((2, 3))], atol=1e-6) and abs(cost() - after) < 1e-6 * abs(after)


def test_passages_of_the_corpus_are_foreseen(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    make = lambda: " ".join(rng.choice(words, 300))
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    texts = {i: make() for i in learn}
    for i, j in zip(learn[:40:2], learn[1:40:2]):
        texts[j] = texts[i]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.bits_per_byte for r in L.lm_scores(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))).collect()}
    twice, once = [out[i] for i in learn[:40]], [out[i] for i in learn[40:]]
    assert max(twice) < min(once) * 0.9


def test_places_and_what_follows():
    h = np.random.default_rng(2).integers(1, 1 << 62, 4000).astype(np.uint64)
    h[2000:2300] = h[100:400]
    size = np.array([1500, 2, 2498])
    at, ctx = L.chosen(h, size)
    assert 150 < len(at) < 350 and all(i - (0 if i < 1500 else 1502) >= 3 for i in at.tolist())
    seq = L.following(h, size, at)
    for i, s in zip(at.tolist(), seq):
        end = 1500 if i < 1500 else 4000
        assert [int(x) for x in s] == [int(h[j]) & 0xFFFFFFFF if j < end else 0xFFFFFFFF for j in range(i, i + L.AHEAD)]
    first = at < 1000
    ahead = L.pa.table({"ctx": ctx[first], "seq": [s.tobytes() for s in seq[first]], "n": np.arange(first.sum()) + 2})
    v = L.Vocabulary(h[:3000], ahead)
    cand, age, often = v.foreseen(h, size)
    for i in range(2003, 2290):
        if cand[i] != -1:
            assert h[cand[i]] == h[i] and 0 <= age[i] < L.AHEAD and often[i] >= 2
    assert (cand[2003:2290] != -1).mean() > 0.2


def test_every_place_of_every_text_is_gathered(spark):
    """Contexts, what followed and words of all texts against brute force; not one place in sixteen."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 60))) for _ in range(300)] + ["", None, "w1 w2 w3", "Rare w1 w2 w3 w4"]
    rows = [(i % 5, [0, 1, 2, 4, -1][int(rng.integers(0, 5))], t) for i, t in enumerate(texts)]
    # Rows of a block lie in several tasks, so that words and contexts are told of more than once.
    told, words = L.gathered(spark.createDataFrame(rows, "block int, fold int, text string").repartition(7), 3)
    got = words.where("block is not null").unionByName(told, allowMissingColumns=True).withColumn("bits", F.lit(3)).toArrow()
    every = words.where("block is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    known, follow, asked, mine = Counter(), {}, {}, {}
    for b, f, t in rows:
        w = tokens(t)
        mine.setdefault(b, set()).update(w)
        for i in range(3, len(w)):
            asked.setdefault(b, set()).add(tuple(w[i - 3 : i]))
            if f != 1:
                follow.setdefault(tuple(w[i - 3 : i]), Counter())[w[i]] += 1
        if f != 1:
            known.update(w)
    assert (every.n, every.v) == (sum(known.values()), len(known))
    code = {w: 0 if w == "\n" else int(L._tokens(L.W.Words(), L.pa.array([w]))[0][0]) for w in {x for s in mine.values() for x in s}}
    for b in mine:
        right = got.filter(L.pa.compute.equal(got.column("block"), b))
        c, codes, ahead = L._parted(right)
        assert sorted(zip(codes.tolist(), c.tolist())) == sorted((code[w], known[w]) for w in mine[b])
        told = {k: (int.from_bytes(s, "little"), n) for k, s, n in zip(ahead.column("ctx").to_numpy().view(np.uint64).tolist(), ahead.column("seq").to_pylist(), ahead.column("n").to_pylist())}
        best = {}
        for ctx in asked[b]:
            n, w = max(((n, code[w] & 0xFFFFFF) for w, n in follow.get(ctx, {}).items()), default=(0, 0))
            if n > 1:
                h = int(L.W.rolled(np.array([code[x] for x in ctx], np.uint64), 3)[0])
                best[h >> 29 << 29] = (w, n)
        assert told == best and len(best) > 100
        unknown = {w for a, x in zip(right.column("sizes").chunks, right.column("bytes").chunks) for w in L._words(a, x)}
        assert unknown == {w.encode() for w in mine[b] if not known[w]}


def test_texts_are_left_out_of_what_weights_are_learned_with():
    rng = np.random.default_rng(13)
    texts = [rng.integers(0, 9, n) for n in (40, 1, 25, 60)]
    flat, size = np.concatenate(texts), np.array([len(t) for t in texts])
    count = np.bincount(flat, minlength=9) + np.array([5, 0, 1, 0, 0, 2, 0, 7, 0])
    code = rng.integers(0, 1 << 63, 9).astype(np.uint64)
    told = np.where(rng.random(len(flat)) < 0.6, -1, rng.integers(0, 9, len(flat)))
    ahead = told, np.zeros(len(flat), np.int64), np.full(len(flat), 2)
    got, at = L.Steps(flat, size, count, code, int(count.sum()), ahead, True), 0
    for k, t in enumerate(texts):
        here = slice(at, at + len(t))
        rest = count - np.bincount(t, minlength=9)
        alone = L.Steps(t, size[k : k + 1], rest, code, int(rest.sum()), tuple(a[here] for a in ahead))
        assert (got.count[here] == alone.count).all() and np.allclose(got.share[here], alone.share) and np.allclose(got.apart[here], alone.apart)
        for (i, *x), (j, *y) in zip(got.of, alone.of):
            m = (i >= at) & (i < at + len(t))
            assert (i[m] - at == j).all() and all(np.allclose(a[m], b) for a, b in zip(x, y))
        at += len(t)
    # What the corpus foresees after three words only because the text itself has it doesn't count; once more elsewhere does.
    h = np.array([11, 12, 13, 14, 15, 11, 12, 13, 14, 0], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ctx = L.W.rolled(h, 3)[:1].view(np.int64)
    for n, want in ((2, False), (3, True)):
        v = L.Vocabulary(np.unique(h), L.pa.table({"ctx": ctx, "seq": [h[3:4].astype(np.uint32).tobytes()], "n": [n]}))
        assert (v.foreseen(h, np.array([10]), True)[0][3] >= 0) == want and v.foreseen(h, np.array([10]))[0][3] >= 0


def test_all_learning_texts_teach_the_weights(spark):
    """What only learning texts outside the former fifth (fold 0) show, that words come again, is learned too."""
    rng = np.random.default_rng(17)
    make = lambda f: " ".join(np.repeat([f"{f}{i}" for i in rng.integers(0, 10**6, 30)], 4))
    rows = [(i, f, make(f)) for i, f in enumerate([2, 3, 4] * 40 + [1] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, f int, text string")
    r = L.lm_scores(df, F.col("f")).where("fold = 1").agg(F.avg("bits_per_byte").alias("x")).first()
    assert r.x < 1.95


def made(n, seed):
    """Texts of some 500 words, many of them frequent, with runs that come again, and what the corpus foresees there."""
    rng = np.random.default_rng(seed)
    words = np.minimum(rng.zipf(1.2, n) - 1, 49_999)
    for at in rng.integers(700, n - 40, n // 100):
        words[at : at + 30] = words[at - 600 : at - 570]
    size = np.diff(np.concatenate(([0], np.sort(rng.choice(np.arange(1, n), n // 500, replace=False)), [n])))
    count, code = np.bincount(words, minlength=50_000) * rng.integers(1, 4, 50_000), rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    guess = np.where(rng.random(n) < 0.5, words, rng.integers(0, 50_000, n))
    told = np.where(rng.random(n) < 0.4, -1, np.where(count[guess] > 0, guess, -2))
    return words, size, count, code, (told, rng.integers(0, L.AHEAD, n), rng.integers(2, 50, n))


def test_words_are_not_searched_for_one_by_one(monkeypatch):
    """A search of each place among all others costs a dozen sorts of them; decisions are worked out by sorts alone."""
    words, size, count, code, ahead = made(20_000, 19)
    total, spelt, info, asked = int(count.sum()), np.full(len(count), -12.0), np.tile(np.eye(L.INPUTS) * 4.0, (3, L.GATES, 1, 1)), []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: asked.append(np.size(v)) or search(a, v, *x, **y))
    chooser = L.Chooser()
    chooser.learn(L.Steps(words, size, count, code, total, ahead, True), info)
    L.word_logs(L.Steps(words, size, count, code, total, ahead), chooser, words, spelt, total)
    assert sum(asked) < 200


def test_texts_come_in_pieces_that_teach_and_cost_what_all_together_do():
    rng = np.random.default_rng(29)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, rng.integers(1, 4000)), 3000)) for _ in range(120)]
    h, size, _ = L._tokens(L.W.Words(), L.pa.array(texts))
    size = size + 1
    code, numbers, count = np.unique(h, return_inverse=True, return_counts=True)
    ctx, at = np.unique(L.contexts(h, size)[1], return_index=True)
    follow = h[L.contexts(h, size)[0]][at].astype(np.uint32)
    ahead = L.pa.table({"ctx": ctx.view(np.int64), "seq": L.pa.array([x.tobytes() for x in follow], L.pa.binary()), "n": np.full(len(ctx), 3)})
    count, total, seen = count * 2, 2 * len(h), []
    together, info = L.Chooser(), np.tile(np.eye(L.INPUTS) * 4.0, (3, L.GATES, 1, 1))
    apart, other = L.Chooser(), info.copy()
    v = L.Vocabulary(code, ahead)
    for _, i, n, foreseen, full in v.texts(L.pa.chunked_array([texts]), L.TOGETHER, True):
        seen.append((i, n, foreseen))
    assert len(seen) > 3 and max(len(i) for i, _, _ in seen) < L.PIECE + L.PART
    assert (np.concatenate([i for i, _, _ in seen]) == numbers).all() and (np.concatenate([n for _, n, _ in seen]) == size).all()
    foreseen = v.foreseen(h, size, True)
    assert all((np.concatenate([f[k] for _, _, f in seen]) == foreseen[k]).all() for k in range(3))
    apart.learn((L.Steps(i, n, count, code, total, f, True) for i, n, f in seen), other)
    together.learn(L.Steps(numbers, size, count, code, total, foreseen, True), info)
    assert (apart.n == together.n).all() and np.allclose(apart.weights, together.weights) and np.allclose(other, info)
    spelt = np.zeros(len(code))
    logs = [L.word_logs(L.Steps(i, n, count, code, total, f), apart, i, spelt, total) for i, n, f in seen]
    assert np.allclose(np.concatenate(logs), L.word_logs(L.Steps(numbers, size, count, code, total, foreseen), apart, numbers, spelt, total))


def test_hashes_that_differ_in_their_lowest_bits_stay_apart():
    rng = np.random.default_rng(31)
    ctx = (rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 3, 3000).astype(np.uint64)
    here, there = L._again(ctx)
    last, want = {}, {}
    for i, x in enumerate(ctx.tolist()):
        if x in last:
            want[i] = last[x]
        last[x] = i
    assert dict(zip(here.tolist(), there.tolist())) == want
    assert [len(x) for x in L._again(ctx[:0])] == [0, 0]


def test_contexts_that_share_a_slot_are_all_found():
    rng = np.random.default_rng(37)
    ctx = np.unique(np.concatenate((rng.integers(0, 1 << 62, 500), (7 << 58) + np.arange(60))).astype(np.uint64))
    have = np.sort(rng.permutation(ctx)[:400])
    v = L.Vocabulary(np.arange(5, dtype=np.uint64), L.pa.table({"ctx": have.view(np.int64), "seq": [b"\0\0\0\0"] * 400, "n": np.arange(400)}))
    row = {x: i for i, x in enumerate(have.tolist())}
    assert v.rows(ctx).tolist() == [row.get(x, -1) for x in ctx.tolist()]
