"""Ranked search over words with dual-sorted wavelet trees, one a shard of documents.

A shard holds some documents in order of their ids and the postings of all their words, a word's list by falling impact.
The documents' numbers in these lists are kept as a wavelet tree (laid out as a matrix: one bit a posting and level, the
numbers' highest bits first). A node of it is a range of documents; a word's list maps to a stretch of the node, by two
ranks a level, and stays in order of impact there, so that its first posting has the largest impact any document below
the node has from the word. Words' weights times these impacts, summed, bound all scores below; at a leaf they are the
score. Search opens the nodes of highest bound first and ends once none can reach the twentieth score: exactly the best
come out, by documents that hold any of the words, without a pass through the lists.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

#: Most text of a shard in bytes (a longer document is a shard of its own) and most documents.
SHARD, DOCS = 8 << 20, 1 << 14
#: Nodes of one search that are opened together.
OPENED = 64
#: Bytes of items' words that travel to all tasks at once; more items than these hold are searched block by block.
BLOCK = 4 << 20
#: Parameters of the score (fixed values).
K, B, SCALE, UNIT = 12, 25, 1000, 1_000_000_000
COLUMNS = ["ids", "words", "start", "impact", "levels", "bits", "n_docs"]

_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in order, A-Z as a-z, coded by a dictionary of bytes, and each text's number of words."""
    data, offs = C.utf8(texts)
    inside = _word[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    count = np.diff(np.searchsorted(starts, offs))
    body = _lower[data[inside]]
    place = np.concatenate(([0], np.cumsum(inside)))
    at = np.append(place[starts], len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    return words.dictionary_encode(), count


def _counted(batches):
    docs = words = 0
    for b in C.slices(batches, "text", 4 << 20):
        data, offs = C.utf8(b.column(0))
        inside = _word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[offs[:-1][offs[:-1] < offs[1:]]] = inside[offs[:-1][offs[:-1] < offs[1:]]]
        n = np.diff(np.concatenate(([0], np.cumsum(first)))[offs])
        docs, words = docs + int((n > 0).sum()), words + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([words])], ["docs", "words"])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a word, and all their words with repeats."""
    per = docs.select(docs[text_col].alias("text")).mapInArrow(_counted, "docs long, words long")
    got = per.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    return got.docs or 0, got.words or 0


def ranks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector as 64-bit words (one more than needed) and the number of ones before each."""
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(len(bits) // 64 + 1, np.uint64)
    words.view(np.uint8)[: len(packed)] = packed
    return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)))


class Tree:
    """The dual-sorted wavelet tree of one shard: ``start`` has where each word's list begins (one more), ``bits`` the
    levels, ``zeros`` how many of a level go left, ``impact`` the impacts in the order of the root."""

    def __init__(self, bits: list[np.ndarray], start: np.ndarray, impact: np.ndarray) -> None:
        self.levels, self.start, n = len(bits), start, len(impact)
        self.words = np.zeros((self.levels, n // 64 + 1), np.uint64)
        self.ones = np.zeros((self.levels, n // 64 + 1), np.int64)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impact = np.zeros((self.levels + 1, n + 1), np.int32)  # at each level, one more for what is empty
        self.impact[0, :n] = now = impact
        for k, b in enumerate(bits):
            self.words[k], self.ones[k] = ranks(b)
            self.zeros[k] = n - int(b.sum())
            self.impact[k + 1, :n] = now = np.concatenate((now[~b], now[b]))

    @staticmethod
    def bits(doc: np.ndarray, levels: int) -> list[np.ndarray]:
        """The levels' bits, highest first: each level goes left or right as a whole, in order."""
        out = []
        for k in range(levels - 1, -1, -1):
            b = (doc >> k & 1).astype(bool)
            out.append(b)
            doc = np.concatenate((doc[~b], doc[b]))
        return out

    def rank(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before ``at`` at ``level``."""
        i = at >> 6
        below = self.words[level, i] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[level, i] + np.bitwise_count(below)

    def best(self, lists: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents' numbers and scores of the ``k`` best for these words (ties: the smaller number), best first."""
        level = np.zeros(1, np.int64)
        doc = np.zeros(1, np.int64)
        lo, hi = self.start[lists][None, :], self.start[lists + 1][None, :]
        bound = (weight * self.impact[0][lo]).sum(1)
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def may(bound, level, doc):
            """Whether a node can still hold one of the best."""
            if len(score) < k:
                return bound > 0
            return (bound > score[-1]) | ((bound == score[-1]) & (doc << (self.levels - level) < found[-1]))

        while len(level):
            take = np.arange(len(level))
            if len(take) > OPENED:
                least = np.partition(bound, -OPENED)[-OPENED]
                sure, even = np.flatnonzero(bound > least), np.flatnonzero(bound == least)
                first = np.argsort(doc[even] << (self.levels - level[even]), kind="stable")
                take = np.concatenate((sure, even[first[: OPENED - len(sure)]]))
            t, l, h, d = level[take], lo[take], hi[take], doc[take]
            leaf = t == self.levels
            if leaf.any():
                found, score = np.concatenate((found, d[leaf])), np.concatenate((score, bound[take][leaf]))
                order = np.lexsort((found, -score))[:k]
                found, score = found[order], score[order]
                t, l, h, d = t[~leaf], l[~leaf], h[~leaf], d[~leaf]
            a, b = self.rank(t[:, None], l), self.rank(t[:, None], h)
            z = self.zeros[t][:, None]
            low, high = np.concatenate((l - a, z + a)), np.concatenate((h - b, z + b))
            d, t = np.concatenate((d * 2, d * 2 + 1)), np.concatenate((t, t)) + 1
            top = self.impact[t[:, None], np.where(low < high, low, self.impact.shape[1] - 1)]
            most = (weight * top).sum(1)
            rest = may(bound, level, doc)
            rest[take] = False
            new = may(most, t, d)
            level, doc = np.concatenate((level[rest], t[new])), np.concatenate((doc[rest], d[new]))
            lo, hi = np.concatenate((lo[rest], low[new])), np.concatenate((hi[rest], high[new]))
            bound = np.concatenate((bound[rest], most[new]))
        return found, score


def _one(x: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def shard_of(ids: pa.Array, texts: pa.Array, n_docs: int, n_words: int) -> pa.RecordBatch:
    """One shard: ids in order, words, where their lists begin, impacts and the tree's bits."""
    order = pc.array_sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    coded, count = terms_of(texts)
    has = np.flatnonzero(count)
    n = len(has)
    doc = np.repeat(np.arange(n), count[has])
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique(word * max(1, n) + doc, return_counts=True)
    word, doc = np.divmod(key, max(1, n))
    m = np.array([100 - B + B * x * n_docs // n_words for x in count[has].tolist()], np.int64)
    impact = UNIT * tf.astype(np.int64) // (SCALE * tf + K * m[doc])
    order = np.lexsort((doc, -impact, word))
    word, doc, impact = word[order], doc[order], impact[order]
    start = np.searchsorted(word, np.arange(len(coded.dictionary) + 1)).astype(np.int64)
    levels = max(1, (n - 1).bit_length())
    bits = b"".join(np.packbits(b, bitorder="little").tobytes() for b in Tree.bits(doc, levels))
    binary = lambda x: pa.array([x], pa.binary())
    cols = [_one(ids.take(pa.array(has))), _one(coded.dictionary.cast(pa.binary())), binary(start.tobytes()), binary(impact.astype(np.int32).tobytes()), pa.array([levels], pa.int32()), binary(bits), pa.array([n_docs])]
    return pa.RecordBatch.from_arrays(cols, COLUMNS)


def search_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index of all rows with a word: a row a shard, (ids, words, start, impact, levels, bits, n_docs).

    Rows are documents, repeated ones too; null texts and those without a word aren't documents. A null id stays null and
    comes after the others. Other columns are not read; an empty table has no shard. Shards are cut where the table is
    read, so nothing is shuffled; a document beyond a shard's size is one of its own.
    """
    n_docs, n_words = corpus_size(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches):
        held, size, rows = [], 0, 0

        def made():
            t = pa.Table.from_batches(held).combine_chunks()
            return shard_of(t.column(0).chunk(0), t.column(1).chunk(0), n_docs, n_words)

        for b in C.slices(batches, "text", SHARD):
            for at in range(0, b.num_rows, DOCS):
                piece = b.slice(at, DOCS)
                long = int(C.utf8(piece.column(1))[1][-1])
                if held and (size + long > SHARD or rows + piece.num_rows > DOCS):
                    yield made()
                    held, size, rows = [], 0, 0
                held.append(piece)
                size, rows = size + long, rows + piece.num_rows
        if held:
            yield made()

    schema = f"ids array<{kind}>, words array<binary>, start binary, impact binary, levels int, bits binary, n_docs long"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return C.staged(rows.mapInArrow(build, schema).where(F.size("ids") > 0), "shards")


def _blocks(items):
    """Items with their distinct words and how often each stands, as many at a time as BLOCK allows."""
    held, size = [], 0
    for r in items:
        coded, _ = terms_of(pa.array([r.text], pa.string()))
        words = Counter(coded.dictionary[i].as_py() for i in coded.indices.to_pylist())
        if not words:
            continue
        held.append((r.item_id, words))
        size += sum(len(w) + 16 for w in words)
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(index: DataFrame, words: list[bytes]) -> DataFrame:
    """(word, n): postings of each of the words, from the shards' words and starts alone."""
    shared = index.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        asked = pa.array(shared.value, pa.binary())
        got = np.zeros(len(asked), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                at = pc.index_in(asked, b.column(0)[i].values).to_numpy(zero_copy_only=False)
                start = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                known = np.flatnonzero(~np.isnan(at))
                w = at[known].astype(np.int64)
                got[known] += start[w + 1] - start[w]
        some = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(got[some])], ["word", "n"])

    return index.select("words", "start").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranked(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item of (item_id, text), ties by document id, null
    ids last. An item without a word, or none of whose words is in the index, has no row; items may repeat and each
    row's result is returned (items with null ids too). An empty index or no items give no rows.

    Items reach the driver a block of bounded size at a time, which is sent to all shards.
    """
    spark, out = index.sparkSession, None
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = index.schema["ids"].dataType.elementType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"item long, item_id {item_kind}, doc_id {doc_kind}, score long"
    n_items = 0
    for block in _blocks(items.select("item_id", "text").toLocalIterator()):
        words = sorted({w for _, x in block for w in x})
        number = {w: i for i, w in enumerate(words)}
        df = {r.word: r.n for r in _frequencies(index, words).collect()}  # as many rows as the block has words
        numbered = [(n_items + i, item, np.array([number[w] for w in x], np.int64), np.array(list(x.values()), np.int64)) for i, (item, x) in enumerate(block)]
        n_items += len(block)
        shared = spark.sparkContext.broadcast((words, df, numbered))

        def search(batches, shared=shared):
            words, df, numbered = shared.value
            asked = pa.array(words, pa.binary())
            for b in batches:
                for i in range(b.num_rows):
                    col = {n: b.column(j)[i] for j, n in enumerate(COLUMNS)}
                    n_docs, levels = col["n_docs"].as_py(), col["levels"].as_py()
                    weight = np.zeros(len(words), np.int64)
                    for w, n in df.items():
                        weight[w] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
                    impact = np.frombuffer(col["impact"].as_buffer(), np.int32)
                    raw = np.frombuffer(col["bits"].as_buffer(), np.uint8).reshape(levels, -1)
                    bits = [np.unpackbits(x, count=len(impact), bitorder="little").astype(bool) for x in raw]
                    tree = Tree(bits, np.frombuffer(col["start"].as_buffer(), np.int64), impact)
                    at = pc.index_in(asked, col["words"].values).fill_null(-1).to_numpy(zero_copy_only=False)
                    ids = col["ids"].values
                    got = []
                    for nth, item, mine, times in numbered:
                        here = at[mine] >= 0
                        if here.any():
                            found, score = tree.best(at[mine][here].astype(np.int64), weight[mine][here] * times[here], k)
                            got.append((nth, item, ids.take(pa.array(found)), score))
                    if got:
                        size = [len(g[3]) for g in got]
                        item_ids = pa.array([g[1] for g in got], item_type).take(pa.array(np.repeat(np.arange(len(got)), size)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], size)), item_ids, pa.concat_arrays([g[2] for g in got]), pa.array(np.concatenate([g[3] for g in got]))], ["item", "item_id", "doc_id", "score"])

        part = index.select(*COLUMNS).mapInArrow(search, schema)
        # Shards' results are cut to the k best of some shards first, so that no task gets all of an item's.
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        few = part.withColumn("some", F.spark_partition_id() % 64)
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).where(F.col("rank") <= k)
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        few = few.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = few if out is None else out.union(C.staged(few, "ranked"))
    return out if out is not None else spark.createDataFrame([], schema).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item; null texts and items, and those without a word, have no rows."""
    return ranked(search_index(C.table(spark, sf_dir, "documents")), C.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS words FROM documents),
tf AS (SELECT r, doc_id, word, count(*) AS tf FROM (SELECT r, doc_id, unnest(words) AS word FROM doc) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
m AS (SELECT r, 75 + (25 * n * docs) // words AS m FROM n, total),
weight AS (SELECT word, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY word),
item AS (SELECT item_id, word, count(*) AS times FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS word FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item JOIN weight USING (word) JOIN tf USING (word) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": SQL}
