import corpus_pipeline as P
from planarlake.llm import decontaminate as D

from test_decontaminate import greedy
from test_linededup import brute as brute_lines
from test_mixing import fill
from test_similar import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", None, "s", 7), (9004, "the and of that with this", None, None, 25)], docs.schema)
    one = P.identify_language(spark, docs.union(odd), SF)
    rows = {r.doc_id: r for r in one.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} | {9004} and rows[9004].lang == "en"

    two = P.dedup_lines(spark, one, SF)
    left = {r.doc_id: r for r in two.collect()}
    want = brute_lines([(d, r.text) for d, r in rows.items()])
    assert {d: r.text for d, r in left.items()} == {d: want[d, r.text][0] for d, r in rows.items()}
    assert all(r.n_chars == len(r.text) and r.source == rows[d].source for d, r in left.items())

    three = P.dedup_near(spark, two, SF)
    groups = brute_groups([(d, r.text) for d, r in left.items()])
    assert sorted(r.doc_id for r in three.collect()) == sorted({g for _, g in groups})

    bench = [b.text.lower().split() for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stay = set()
    for r in three.collect():
        t = r.text.lower().split()
        seeds = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        near = [b for b in bench if any(tuple(b[i : i + 5]) in seeds for i in range(len(b) - 4))]
        if not any(sum(n for _, _, n in greedy(b, t)) >= D.COVERED * len(b) for b in near):
            stay.add(r.doc_id)
    four = P.decontaminate_benchmark(spark, three, SF)
    assert {r.doc_id for r in four.collect()} == stay and len(stay) < three.count()
    assert four.columns == P.COLUMNS

    five = P.mix_sources(spark, four, SF).collect()
    size = {r.doc_id: (r.source, len(r.text.split())) for r in four.collect()}
    sizes, longest, taken = {}, {}, {}
    for s, n in size.values():
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(longest.get(s, 0), n)
    for r in five:
        s, n = size[r.doc_id]
        taken[s] = taken.get(s, 0) + n
        assert 1 <= r.copy <= 2
    target = fill(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= longest[s] for s in sizes)


def test_mix_keeps_rows_of_null_and_repeated_ids_apart(spark):
    rows = [(None, "a b c", "en", "s", 5), (None, "d e f", "en", "s", 5), (5, "g h i", "en", "t", 5), (5, "j k l", None, "t", 5), (6, "m n", "en", None, 3), (6, "m n", "en", None, 3), (7, None, "en", "s", None), (8, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in P.mix_sources(spark, df, "").collect()]
    assert all(got.count(r) <= 2 * rows.count(r) for r in got)
    # 150 % of 13 words by weights 5 and 2 (and 1 for null): the sum comes near that.
    assert abs(sum(len((r[1] or "").split()) for r in got) - 24) <= 9
    assert P.mix_sources(spark, df.limit(0), "").count() == 0


def test_run(spark):
    """What run() gives is clean by brute force, keeps its documents' other columns, and is what the stages give in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    before = {r.doc_id: r for r in docs.collect()}
    rows = P.run(spark, SF).collect()
    assert all((r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) and r.n_chars == len(r.text) for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    assert len(set(brute_groups(list(texts.items())))) == len(texts)
    bench = [b.text.lower().split() for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for text in texts.values():
        t = text.lower().split()
        seeds = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        near = [b for b in bench if any(tuple(b[i : i + 5]) in seeds for i in range(len(b) - 4))]
        assert not any(sum(n for _, _, n in greedy(b, t)) >= D.COVERED * len(b) for b in near)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema if stage is not P.mix_sources else None)
    assert sorted((r.doc_id, r.copy, r.text) for r in docs.collect()) == sorted((r.doc_id, r.copy, r.text) for r in rows)
