"""Grouping of spelling variants by letter-parity masks.

A word's mask has a bit for each letter (some rare ones share one) that says whether the letter stands in it an odd number
of times. One inserted or deleted code point flips one bit at most, a replaced one two, so of three bands of the mask one is
the same in both words. Words meet by a band and by lengths that differ by one at most; of words that long one edit
also leaves the front or the back half alone, which goes into the key so that a band that many words have in common
doesn't bring all of them together. What meets is verified by the edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Letters, frequent ones first, so that they are dealt evenly over the bands; the bits of a band.
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"
BAND = 21
#: Distinct words whose counts a task keeps before it hands them on, in characters.
CHARS = 1 << 24
#: Longest run whose checksum is carried on by tables.
TABLED = 64

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def bit_of() -> dict[str, int]:
    """The mask's bit of each code point: letters in turn to the three bands, U+00C0 to U+00FF after them, round again."""
    order = LETTERS + "".join(map(chr, range(0xC0, 0x100)))
    return {c: i % 3 * BAND + i // 3 % BAND for i, c in enumerate(order)}


def runs_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) in order, A-Z as a-z, and each text's number of runs."""
    data, offs = C.utf8(texts)
    lead = data == 0xC3  # of U+00C0 to U+00FF, and of nothing else
    inside = _letter[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    count = np.diff(np.searchsorted(starts, offs))
    body = _lower[data[inside]]
    place = np.concatenate(([0], np.cumsum(inside)))
    at = np.append(place[starts], len(body)).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
    return runs.dictionary_encode(), count


class Carry:
    """crc32 of a text followed by another, from the checksums of both: the first one's is carried over the second's
    bytes by tables for each length, as checksums are linear."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def table(self, n: int) -> np.ndarray:
        if n not in self.tables:
            zeros = bytes(n)
            one = np.array([zlib.crc32(zeros, 1 << i) ^ zlib.crc32(zeros) for i in range(32)], np.uint32)
            t = np.zeros((4, 256), np.uint32)
            for k in range(4):
                for i in range(8):
                    t[k, 1 << i : 2 << i] = t[k, : 1 << i] ^ one[8 * k + i]
            self.tables[n] = t
        return self.tables[n]

    def join(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = second.copy()
        for n in np.unique(length).tolist():
            t, at = self.table(n), np.flatnonzero(length == n)
            x = first[at]
            out[at] ^= t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return out


def word_counts(docs: DataFrame, least: int = 6, drop: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``least`` code points or more: runs of letters, one code point taken out of those whose
    checksum with the document's id ``drop`` divides.

    Null and empty texts have none; a null id counts as an empty one in the checksum; repeated rows count again. Other
    columns are not read.
    """

    def count(batches):
        carry, held, chars = Carry(), Counter(), 0

        def out():
            words = list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

        for b in C.slices(batches, "text", 4 << 20):
            coded, many = runs_of(b.column(1))
            runs = coded.dictionary.to_pylist()
            size = np.array([len(r) - r.count(b"\xc3") for r in runs], np.int64)
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(many)), many)
            long = size[code] >= least if len(code) else np.zeros(0, bool)
            code, doc = code[long], doc[long]
            heads = [f"{'' if d is None else d}:".encode() for d in b.column(0).to_pylist()]
            head = np.array([zlib.crc32(h) for h in heads], np.uint32)
            tail = np.array([zlib.crc32(r) for r in runs], np.uint32)
            length = np.array([len(r) for r in runs], np.int64)
            short = length[code] <= TABLED if len(code) else np.zeros(0, bool)
            h = np.zeros(len(code), np.uint32)
            h[short] = carry.join(head[doc[short]], tail[code[short]], length[code[short]])
            for i in np.flatnonzero(~short).tolist():
                h[i] = zlib.crc32(runs[code[i]], int(head[doc[i]]))
            hit = h % drop == 0
            n = np.bincount(code[~hit], minlength=len(runs))
            some = np.flatnonzero(n)
            for i, x in zip(some.tolist(), n[some].tolist()):
                held[runs[i].decode()] += x
            for i in np.flatnonzero(hit).tolist():
                w = runs[code[i]].decode()
                at = int(h[i]) % len(w)
                if len(w) > least:
                    held[w[:at] + w[at + 1 :]] += 1
            chars += int(length[some].sum())
            if chars > CHARS:
                yield out()
                held.clear()
                chars = 0
        if held:
            yield out()

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(batches):
    bit = bit_of()
    low = (1 << BAND) - 1
    for b in batches:
        rows = []
        for w in b.column(0).to_pylist():
            mask = 0
            for c in w:
                mask ^= 1 << bit[c]
            for least in (len(w) - 1, len(w)):
                half = least // 2
                for side, part in ((0, w[:half]), (1, w[half - least :])):
                    rows += [(w, mask, k, mask >> k * BAND & low, least, side, part) for k in range(3)]
        yield pa.RecordBatch.from_pylist([dict(zip(KEYED, r)) for r in rows], pa.schema([("word", pa.string()), ("mask", pa.int64()), ("band", pa.int32()), ("bits", pa.int64()), ("least", pa.int32()), ("side", pa.int32()), ("half", pa.string())]))


KEYED = ["word", "mask", "band", "bits", "least", "side", "half"]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all distinct words of (word) that differ by exactly one inserted, deleted or replaced code point, once
    each way. Words must be of code points that masks know, and of two or more; an empty table gives an empty one."""
    keys = words.select("word").mapInArrow(_keyed, "word string, mask long, band int, bits long, least int, side int, half string")
    keys = C.staged(keys, "keys")
    by = KEYED[2:]
    other = keys.select(F.col("word").alias("b"), F.col("mask").alias("other"), *by)
    met = keys.withColumnRenamed("word", "a").join(other, by)
    # Of two words at least one is as long as the key says, masks differ by two bits at most.
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("mask").bitwiseXOR(F.col("other"))) <= 2) & (F.least(F.length("a"), F.length("b")) == F.col("least"))
    once = met.where(near & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()
    return once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def spelling_groups(counts: DataFrame, least: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that stand ``least`` times or more in (word, n).

    ``form`` is the near word of largest n (ties: the first in code-point order) if its n is ``ratio`` times the word's
    or more, ``root`` the end of the chain of forms; as n grows by the ratio along it, chains are short and have no
    cycles. An empty table gives an empty one.
    """
    words = C.staged(counts.where(F.col("n") >= least).select("word", "n"), "words")
    pairs = C.staged(near_pairs(words), "near")
    best = pairs.join(words.withColumnRenamed("word", "b").withColumnRenamed("n", "other_n"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("b").alias("word"))).alias("best")
    )
    found = words.join(best, words["word"] == best["a"], "left").drop("a")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = found.select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n")
    )
    found = C.staged(found, "forms")
    # Pointers are doubled: after a round each word points twice as far, or to the end.
    root = C.staged(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = C.staged(root.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        C.discard(root)
        root = new.select("word", "root")
        root.staged_at = new.staged_at
        if not new.where("moved").limit(1).count():
            break
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling groups of the words of all documents, as the contract takes them; null texts have no words."""
    return spelling_groups(word_counts(C.table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: The SQL at hand has no crc32; tests hold the query against brute force.
ORACLES: dict[str, str] = {}
