"""Token counts by rank-synchronous array merging of a public byte-level BPE vocabulary."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C

_SPACE = r"[\t-\r \x85\xa0  -     　]"
_NOT = _SPACE[1:-1]
#: The public pre-token pattern, with white space spelt out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_NOT}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_NOT}])|{_SPACE}+"
#: Distinct pieces whose counts a worker keeps, and characters of these.
MEMORY, CHARS = 1_000_000, 1 << 24
NONE = np.iinfo(np.int64).max


def byte_names() -> list[str]:
    """The printable name that byte-level vocabularies give each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts tokens of many pre-tokens at once, each step merging every sequence's lowest-rank pair."""

    def __init__(self, model: bytes) -> None:
        j = json.loads(model)
        vocab = j["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for c in byte_names()], np.int64)
        pair = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in j.get("added_tokens", [])]
        self.split = regex.compile(PATTERN)
        self.odd = regex.compile(f"{_SPACE} {_SPACE}")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}
        self.pre: dict[str, int] = {}
        self.chars = 0

    def surviving(self, seqs: list[bytes]) -> np.ndarray:
        """How many symbols are left of each byte string when no pair can be merged any more."""
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        out = lens.copy()
        live = np.flatnonzero(lens > 1)
        if not len(live):
            return out
        sym = self.byte_id[np.frombuffer(b"".join(seqs[i] for i in live), np.uint8)]
        size = lens[live]
        while len(live):
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            seq = np.repeat(np.arange(len(size)), size)
            rank = np.full(len(sym), NONE)
            if len(sym) > 1:
                key = sym[:-1] * self.size + sym[1:]
                at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                ok = (self.pair[at] == key) & (seq[1:] == seq[:-1])
                rank[:-1][ok] = self.rank[at[ok]]
            best = np.minimum.reduceat(rank, starts)
            hit = (rank == best[seq]) & (rank != NONE)
            # Of overlapping hits (a a a), every second one counts, from the left.
            first = hit.copy()
            first[1:] &= ~hit[:-1] | (seq[1:] != seq[:-1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(sym)), 0))
            hit &= (np.arange(len(sym)) - run) % 2 == 0
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[1:] = ~hit[:-1]
            size = np.add.reduceat(stay.astype(np.int64), starts)
            done = best == NONE
            out[live] = size
            stay &= ~(done | (size < 2))[seq]
            sym = sym[stay]
            live, size = live[~(done | (size < 2))], size[~(done | (size < 2))]
        return out

    def learn(self, pieces) -> None:
        """Count pieces that are new: cut into pre-tokens, merge the new ones of these together."""
        if len(self.known) > MEMORY or len(self.pre) > MEMORY or self.chars > CHARS:
            self.known.clear(), self.pre.clear()
            self.chars = 0
        new = [p for p in pieces if p not in self.known]
        cuts = [self.split.findall(p) for p in new]
        fresh = list({t for c in cuts for t in c if t not in self.pre})
        if fresh:
            self.pre.update(zip(fresh, self.surviving([t.encode() for t in fresh]).tolist()))
        self.chars += sum(map(len, new)) + sum(map(len, fresh))
        pre = self.pre
        for p, c in zip(new, cuts):
            self.known[p] = sum(pre[t] for t in c)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text. A text falls apart where one space follows other text, as no pre-token
        reaches over such a place; texts with white space on both sides of a space, or a space at the end, are cut by the
        pattern."""
        cut, out, todo = self.cut, [0] * len(texts), []
        pieces: set[str] = set()
        for i, t in enumerate(texts):
            parts = [t]
            if cut and any(s in t for s in self.special):
                out[i] += len(cut.findall(t))
                parts = cut.split(t)
            for p in parts:
                if not p:
                    continue
                if "  " in p or p[-1] == " " or self.odd.search(p):
                    words = [p]
                else:
                    first, *words = p.split(" ")
                    words = [f" {w}" for w in words]
                    if first:
                        words.append(first)
                pieces.update(words)
                todo.append((i, words))
        self.learn(pieces)
        get = self.known.__getitem__
        for i, words in todo:
            out[i] += sum(map(get, words))
        return out


def token_counts(docs: DataFrame, model: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text under the vocabulary file ``model`` (a byte-level BPE in JSON).

    The file is read on the driver and sent out once (its size is fixed by the vocabulary). Null and empty texts have
    no bytes and no tokens; repeated rows are counted each; a null id stays null; other columns are not read.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def count(batches):
        merger = None
        for b in C.slices(batches):
            merger = merger or RankMerger(shared.value)
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = np.array(merger.counts(texts), np.int64)
            size = np.diff(C.utf8(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts of all documents under the vocabulary that the contract names."""
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
