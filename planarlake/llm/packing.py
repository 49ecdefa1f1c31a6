"""Best-fit packing of tokenised documents into training sequences, with large items matched first.

A document's ids (an end id after them) make pieces of at most ``capacity`` ids; only longer documents are cut, the rest
that makes their first piece being what is left over. Pieces of one length are alike to the packing, so it is planned on
the histogram of lengths, which has ``capacity`` entries whatever the corpus: pieces above a third of the capacity stand at
most twice in a sequence and are matched greedily, each of the largest with the largest that still fits; smaller ones, by
falling length, go to the smallest gap that takes them. Runs of like sequences are planned at once. Each piece then finds
its place from its rank among the pieces of its length, which is its number within the task that wrote it after the
counts of the tasks before.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: White space of one byte, and the other white space that the vocabulary's pre-tokens know, as UTF-8 (fixed values).
ASCII_SPACE = [9, 10, 11, 12, 13, 32]
WIDE_SPACE = "\x85\xa0                　"
#: Kinds of one-byte characters between which pre-tokens end, going on from one to another of the first three; not after an
#: apostrophe, which can begin a pre-token with the letters behind it, nor before one that belongs to what stands before.
LETTER, DIGIT, OTHER, QUOTE = 1, 2, 3, 4
#: Distinct stretches whose ids a worker keeps, ids of these and bytes; stretches that the library gets at a time.
MEMORY, IDS, CHARS, ASKED = 1_000_000, 6_000_000, 1 << 24, 4_000
#: Bytes of text that are coded together.
TOGETHER = 6 << 20
#: Bits of a rank in the keys that ranks are looked up by.
RANK = 44


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct stretch.

    No pre-token of a byte-level vocabulary reaches over a place where white space follows something else, or where plain
    letters, digits and other signs meet, so texts fall apart there, and so do their ids. Stretches are told apart by their bytes. New ones are handed over many at a time,
    with a special token between them, which comes back as an id of its own.
    """

    def __init__(self, model: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.lib, self.end_id = Tokenizer.from_str(model), end_id
        self.space = np.zeros(256, bool)
        self.space[ASCII_SPACE] = True
        self.kind = np.zeros(256, np.uint8)
        for kind, some in ((LETTER, [*range(65, 91), *range(97, 123)]), (DIGIT, range(48, 58)), (OTHER, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), (QUOTE, [39])):
            self.kind[list(some)] = kind
        wide = [c.encode() for c in WIDE_SPACE]
        self.wide2 = np.array([c[0] << 8 | c[1] for c in wide if len(c) == 2])
        self.wide3 = np.array([c[0] << 16 | c[1] << 8 | c[2] for c in wide if len(c) == 3])
        added = json.loads(model)["added_tokens"]
        self.special = [t["content"].encode() for t in added]
        plain = [t for t in added if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        # None that could also be read from its own end on, or from within a stretch.
        self.between = next(((t["content"].encode(), t["id"]) for t in plain if not any(t["content"].endswith(t["content"][:k]) for k in range(1, len(t["content"])))), None)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.size, self.flat, self.used, self.chars = np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0, 0
        self.start = np.zeros(0, np.int64)
        self.add(np.array([self.end_id], np.uint32), np.array([1]))  # stretch 0 is what ends a document

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)))
        self.start = np.concatenate((self.start, self.used + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where stretches begin: at texts' starts, and where white space follows something else."""
        space = self.space[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        at = np.flatnonzero(begins)
        odd = data[at - 1] >= 0x80  # the end of wide white space?
        if odd.any():
            far = at[odd]
            d = [data[np.maximum(far - k, 0)].astype(np.int64) for k in (1, 2, 3)]
            ended = np.isin(d[1] << 8 | d[0], self.wide2) | np.isin(d[2] << 16 | d[1] << 8 | d[0], self.wide3)
            begins[far[ended]] = False
        kind = self.kind[data]
        now, before = kind[1:], kind[:-1]
        begins[1:-1] |= (now != before) & (now > 0) & (before > 0) & (before != QUOTE) & ~((now == QUOTE) & (before == OTHER))
        body = data.tobytes()
        for t in self.special:  # stays in one stretch
            i = body.find(t)
            while i >= 0:
                begins[i + 1 : i + len(t)] = False
                i = body.find(t, i + 1)
        begins[offs] = True
        begins[-1] = False
        return np.flatnonzero(begins)

    def ask(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches on end, and how many each has."""
        text = self.between[0].join(new) if self.between else b""
        if not self.between or text.count(self.between[0]) != len(new) - 1:  # some have it themselves
            ids = [self.lib.encode(w.decode(), add_special_tokens=False).ids for w in new]
            return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        ids = np.array(self.lib.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(ids == self.between[1])
        return np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1

    def learn(self, words: pa.Array) -> np.ndarray:
        """Numbers of these stretches; the library is asked for those that are new."""
        if len(self.size) > MEMORY or self.used > IDS or self.chars > CHARS:
            self.forget()
        at = pc.index_in(words, self.known)
        new = words.filter(at.is_null())
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        if len(new):
            out[at.is_null().to_numpy(zero_copy_only=False)] = len(self.size) + np.arange(len(new))
            for i in range(0, len(new), ASKED):
                self.add(*self.ask(new.slice(i, ASKED).to_pylist()))
            self.known = pa.concat_arrays([self.known, new])
            self.chars += int(pc.sum(pc.binary_length(new)).as_py())
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end, each text's followed by the end id, and where each text's begin (one more)."""
        data, offs = C.utf8(texts)
        at = self.cuts(data, offs) if len(data) else np.zeros(0, np.int64)
        ends = np.concatenate((at, [len(data)])).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        number = self.learn(coded.dictionary)
        stretch = number[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        last = np.searchsorted(at, offs[1:])  # stretches before each text's end
        stretch = np.insert(stretch, last, 0)
        size = self.size[stretch]
        begins = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.start[stretch] - begins, size) + np.arange(int(size.sum()))]
        done = np.concatenate(([0], (begins + size)[last + np.arange(len(last))])) if len(last) else np.zeros(1, np.int64)
        return flat, done


@lru_cache(1)
def encoder(model: str, end_id: int) -> Encoder:
    """A worker's encoder, which keeps what it has learnt from one task to the next."""
    return Encoder(model, end_id)


def token_pieces(docs: DataFrame, model: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth [, ids]): every document's pieces under the vocabulary file.

    A null text is an empty one, whose only piece is the end id. Rows are documents: null and repeated ids and repeated
    rows give their own pieces. Other columns are not read; an empty table has none. ``part`` and ``nth`` number the
    pieces of a length within a task, so the result must be staged before it is read twice. ``keep_ids`` adds the ids.
    """
    spark = docs.sparkSession
    with open(model, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        part, coder, seen = TaskContext.get().partitionId(), None, np.zeros(capacity + 1, np.int64)
        for b in C.slices(batches, max_bytes=TOGETHER):
            coder = coder or encoder(shared.value, end_id)
            flat, at = coder.ids(b.column(1))
            total = np.diff(at)
            n = (total + capacity - 1) // capacity
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = total - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            order = np.argsort(length, kind="stable")
            by = length[order]
            place = np.empty(len(by), np.int64)
            place[order] = np.arange(len(by)) - np.searchsorted(by, by)
            nth = seen[length] + place
            seen += np.bincount(length, minlength=capacity + 1)
            little = flat.astype("<u4", copy=False)
            a = at[:-1][row] + start
            crc = [zlib.crc32(little[x:y]) for x, y in zip(a.tolist(), (a + length).tolist())]
            cols = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:  # a text's pieces lie on end, so the pieces' offsets are all there is to it
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, at[-1]), pa.int32()), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(cut, schema)


def planned(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of like sequences, (how many, [(length, times), ...]), for so many pieces of each length from 1 to capacity."""
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list] = defaultdict(list)  # by what is free: [how many, lengths and times]
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] > (b == a)), None)
            if b is None:
                m, what = left[a], [(a, 1)]
            elif b == a:
                m, what = left[a] // 2, [(a, 2)]
            else:
                m, what = min(left[a], left[b]), [(a, 1), (b, 1)]
            for k, times in what:
                left[k] -= m * times
            gaps[capacity - sum(k * times for k, times in what)].append([m, what])
    for s in range(capacity // 3, 0, -1):
        n = left.get(s, 0)
        for g in [g for g in range(s, capacity + 1) if gaps.get(g)] if n else []:
            # What is best-fit here goes on fitting best until less than s is free.
            k, here = g // s, gaps.pop(g)
            for m, what in here:
                full, odd = (m, 0) if n >= k * m else divmod(n, k)
                for times, many in ((k, full), (odd, int(odd > 0)), (0, m - full - (odd > 0))):
                    if many:
                        gaps[g - times * s].append([many, what + [(s, times)] * (times > 0)])
                n -= k * full + odd
        if n:
            full, odd = divmod(n, capacity // s)
            for times, many in ((capacity // s, full), (odd, int(odd > 0))):
                if many:
                    gaps[capacity - times * s].append([many, [(s, times)]])
    return [(m, what) for g in sorted(gaps) for m, what in gaps[g]]


def placement(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where ranks go: for each run and length the first rank that it takes (as a key with the length), how many of
    that length a sequence holds, the offset of the first, and the run's first sequence."""
    key, times, offset, first, taken, at = [], [], [], [], defaultdict(int), 0
    for m, what in plan:
        o = 0
        for k, t in what:
            key.append((k << RANK) + taken[k])
            times.append(t), offset.append(o), first.append(at)
            taken[k] += m * t
            o += k * t
        at += m
    order = np.argsort(np.array(key, np.int64))
    return {n: np.array(x, np.int64)[order] for n, x in (("key", key), ("times", times), ("offset", offset), ("first", first))}


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (staged, as token_pieces gives them) with sequence_id and offset instead of part and nth.

    Sequences are numbered from 0 and filled without gaps; none holds more than ``capacity`` ids. Which of the pieces of
    one length goes where follows the order of the staged rows. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    count = pieces.groupBy("part", "length").agg(F.max("nth").alias("n")).withColumn("n", F.col("n") + 1)
    count = C.staged(count, "lengths")
    counts = {r.length: r.n for r in count.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(placement(planned(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = count.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]

    def place(batches):
        t = table.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = (length << RANK) + rank
            i = np.searchsorted(t["key"], key, "right") - 1
            nth, slot = np.divmod(key - t["key"][i], t["times"][i])
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t["first"][i] + nth), pa.array(t["offset"][i] + slot * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*kept).schema)
    return ranked.select(*kept, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the packed sequences themselves, from pieces with their ids; starts has where each
    piece begins. A sequence is as long as the capacity at most, so what is gathered is bounded."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the vocabulary and end id that the contract names, packed to sequences of 1024 ids. Null texts
    are empty, empty ones hold the end id alone, rows are documents."""
    import public_tokenizers

    pieces = C.staged(token_pieces(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
#: SQL has no tokenizer; tests hold the query against the library and an exhaustive packing of small cases.
ORACLES: dict[str, str] = {}
