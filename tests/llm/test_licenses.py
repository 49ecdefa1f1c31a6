import random
import re

from planarlake.llm import licenses as L


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for p, label in L.PHRASES:
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns_and_notices(spark):
    rnd = random.Random(4)
    parts = ["MIT License", "apache", "license", "CC-BY", "cc by", "GNU General Public License", "gnu general", "the", "été", "of\n", "0x", "Kcc"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "cc by"), (502, "mit license"), (502, "mit license"), (503, "x " * 50000 + "cc by")]
    bsd = L.NOTICES[3][0].split()
    rows += [(600, "a b " + " ".join(bsd[:9] + ["hm"] + bsd[9:])), (601, " ".join(bsd[:8])), (602, " ".join(reversed(bsd)))]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n_words int, label string")
    got = L.license_labels(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((d, *brute(t)) for d, t in rows), key=key)
    by = {r.doc_id: r for r in got}
    assert by[600].labels == "bsd" and 0.8 <= by[600].score < 1
    assert by[601].labels == "" and 0 < by[601].score < 0.8
    assert by[602].labels == "" and by[500].score == 0
    assert L.license_labels(df.limit(0)).count() == 0


def chain(notice, words):
    """Largest share of a notice's pairs on a band, in order, found by trying all bands and growing chains."""
    n, best = len(notice) - 1, 0
    hits = [(i, j) for i in range(len(words) - 1) for j in range(n) if words[i : i + 2] == notice[j : j + 2]]
    for d in {i - j for i, j in hits}:
        longest = {}
        for i, j in sorted((i, j) for i, j in hits if d <= i - j <= d + L.BAND):
            longest[i, j] = 1 + max((m for (a, b), m in longest.items() if a < i and b < j), default=0)
        best = max(best, *longest.values())
    return best / n


def test_labels_and_scores_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(0, "of the " * 40), (1, "the license " * 20), (2, "all rights all rights"), (3, "All rights, reserved all rights reserved")]
    for i in range(4, 120):
        w = rnd.choice(L.NOTICES)[0].split()
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 2)] = rnd.choice([[], ["x"], ["of", "the"], [w[k]], w[:4]])
        rows.append((i, " ".join([rnd.choice(["of", "the", "z"]) for _ in range(rnd.randint(0, 30))] + w + ["rights", "all", "of"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in L.license_labels(df).collect():
        t = dict(rows)[r.doc_id]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        share = [(chain(p.split(), words), label) for p, label in L.NOTICES]
        _, n_base, _, _, base = brute(t)
        labels = {x for s, x in share if s >= L.COVERED} | set(base.split(",")) - {""}
        assert r.labels == ",".join(sorted(labels)), t
        assert r.score == (1.0 if n_base else max(s for s, _ in share)), t
        assert r.doc_id > 2 or r.labels == ""
