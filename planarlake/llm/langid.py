"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood sums the products of
its pieces over all ways to cut it into pieces (forward algorithm); a text's is the product of its words'. Piece
probabilities are learned by expectation-maximisation from word counts by language: expected piece counts come from
forward and backward sums, added up by Spark.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MARK = "▁"
#: Words up to so many characters are summed as they are, longer ones in logs: the same sums without underflow.
SHORT = 16
#: Numbers in a batch of sums, and in the table of words' scores that a worker keeps: memory, whatever the languages.
CELLS, MEMORY = 1 << 20, 1 << 21
#: Characters of words that one lattice takes, and that a worker keeps as keys.
CHARS, KEYS = 1 << 16, 1 << 24
#: Added to each piece's expected count.
SMOOTH = 0.1
#: A character that no piece covers, as a share of the pieces' mass.
UNKNOWN = 1e-7


def pieces_of(model: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary without its special and byte ones, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kept = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(kept))


class Pieces:
    """Finds pieces among the substrings of many words at once: rolling hashes of all their beginnings in direct tables."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]) -> None:
        number = {p: i for i, p in enumerate(pieces)}
        begin = list(dict.fromkeys(p[:n] for p in pieces for n in range(1, len(p) + 1)))
        self.hash = np.array([self._of(x) for x in begin], np.uint64)
        self.piece = np.array([number.get(x, -1) for x in begin], np.int64)
        self.longest = max(map(len, pieces), default=1)
        self.levels = []
        left = np.arange(len(begin))
        shift = 43
        while len(left):  # those whose slot is taken go to a further table
            slot = (self.hash[left] * np.uint64(0xBF58476D1CE4E5B9 + 2 * shift) >> np.uint64(shift)).astype(np.int64)
            table = np.full(1 << (64 - shift), -1, np.int32)
            table[slot] = left
            self.levels.append((shift, table))
            left = left[table[slot] != left]
            shift += 2

    def _of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Which beginning of a piece has each hash; -1 for none."""
        out = np.full(len(h), -1, np.int64)
        for shift, table in self.levels:
            at = table[(h * np.uint64(0xBF58476D1CE4E5B9 + 2 * shift) >> np.uint64(shift)).astype(np.int64)]
            hit = (at >= 0) & (self.hash[at] == h)
            out[hit] = at[hit]
        return out


class Lattice:
    """All piece occurrences in a batch of distinct words, for forward and backward sums on all words at once."""

    def __init__(self, words: list[str], index: Pieces) -> None:
        self.n = len(words)
        self.length = np.fromiter(map(len, words), np.int64, self.n)
        self.longest = index.longest
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        own = np.repeat(np.arange(self.n), self.length)
        place = np.arange(len(own)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        room = self.length[own] - place
        at, h = np.arange(len(own)), np.zeros(len(own), np.uint64)
        word, start, end, piece = [], [], [], []
        for size in range(1, index.longest + 1):
            live = room[at] >= size
            at, h = at[live], h[live]
            if not len(at):
                break
            h = h * index.BASE + point[at + size - 1]
            f = index.find(h)
            p = np.where(f >= 0, index.piece[f], -1)
            hit = np.flatnonzero(p >= 0) if size > 1 else slice(None)
            i = at[hit]
            word.append(own[i]), start.append(place[i]), end.append(place[i] + size), piece.append(p[hit])
            at, h = at[f >= 0], h[f >= 0]
        self.word, self.start, self.end, self.piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, start, end, piece))
        self.most = int(self.length.max()) if self.n else 0
        self.by_end = np.argsort(self.end * self.n + self.word, kind="stable")
        self.ends = np.searchsorted(self.end[self.by_end], np.arange(self.most + 2))

    def forward(self, prob: np.ndarray, logs: bool = True, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(natural logs of the words' likelihoods (n, k), sums up to the last places (n, places, k)).

        prob has a row a piece (the last for unknown characters) and a column a language, in logs if ``logs``, as are the
        sums then. Sums are kept for as many places as the longest piece has. ``before`` has the sums (1, places, k) of
        the first places of an only word that is the next part of a longer one."""
        k, ring = prob.shape[1], self.longest + 1
        add, none = (np.logaddexp, -np.inf) if logs else (np.add, 0.0)
        alpha = np.full((self.n, ring, k), none)
        done = 0
        if before is None:
            alpha[:, 0] = 0.0 if logs else 1.0
        else:
            done = before.shape[1] - 1
            alpha[:, : done + 1] = before
        total = np.array(alpha[:, done % ring])
        for e in range(done + 1, self.most + 1):
            arcs = self.by_end[self.ends[e] : self.ends[e + 1]]
            w = self.word[arcs]
            p, was = prob[self.piece[arcs]], alpha[w, self.start[arcs] % ring]
            part = was + p if logs else was * p
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            sums = add.reduceat(part, first, axis=0)
            w = w[first]
            alpha[w, e % ring] = sums
            over = self.length[w] == e
            total[w[over]] = sums[over]
        last = alpha[:, np.arange(max(0, self.most - self.longest + 1), self.most + 1) % ring]
        if not logs:
            with np.errstate(divide="ignore"):
                total = np.log(total)
        return total, last

    def expected(self, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, weighted by the words' counts; prob has the logs of one language."""
        alpha, beta = (np.full((self.n, self.most + 1), -np.inf) for _ in range(2))
        alpha[:, 0] = 0
        for e in range(1, self.most + 1):
            arcs = self.by_end[self.ends[e] : self.ends[e + 1]]
            w = self.word[arcs]
            part = alpha[w, self.start[arcs]] + prob[self.piece[arcs]]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            alpha[w[first], e] = np.logaddexp.reduceat(part, first)
        beta[np.arange(self.n), self.length] = 0
        order = np.argsort((self.most - self.start) * self.n + self.word, kind="stable")
        cuts = np.searchsorted(-self.start[order], np.arange(-self.most, 2))
        for at in range(self.most):
            arcs = order[cuts[at] : cuts[at + 1]]
            if len(arcs):
                w = self.word[arcs]
                part = beta[w, self.end[arcs]] + prob[self.piece[arcs]]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                beta[w[first], self.start[arcs[first]]] = np.logaddexp.reduceat(part, first)
        total = alpha[np.arange(self.n), self.length]
        use = np.exp(alpha[self.word, self.start] + prob[self.piece] + beta[self.word, self.end] - total[self.word]) * count[self.word]
        known = self.piece >= 0
        return np.bincount(self.piece[known], use[known], len(prob))


def expected_long(word: str, index: Pieces, prob: np.ndarray, count: float) -> np.ndarray:
    """``Lattice.expected`` of one word, a lattice a part: sums of all its places are carried from part to part, forwards
    by the pieces' ends and backwards by their starts."""
    n, over = len(word), index.longest - 1
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for a in range(0, n, CHARS):
        skip = min(a, over)
        part = Lattice([word[a - skip : a + CHARS]], index)
        begin, weight = part.start[part.by_end] + a - skip, prob[part.piece[part.by_end]]
        for e in range(skip + 1, part.most + 1):
            arcs = slice(part.ends[e], part.ends[e + 1])
            alpha[a - skip + e] = np.logaddexp.reduce(alpha[begin[arcs]] + weight[arcs])
    out = np.zeros(len(prob))
    for a in range((n - 1) // CHARS * CHARS, -1, -CHARS):
        part = Lattice([word[a : a + CHARS + over]], index)
        by = np.argsort(part.start, kind="stable")
        start, end, piece = part.start[by] + a, part.end[by] + a, part.piece[by]
        cuts = np.searchsorted(start, np.arange(a, min(a + CHARS, n) + 1))
        weight = prob[piece]
        for at in range(len(cuts) - 2, -1, -1):
            arcs = slice(cuts[at], cuts[at + 1])
            beta[a + at] = np.logaddexp.reduce(beta[end[arcs]] + weight[arcs])
        mine = slice(0, cuts[-1])  # pieces that start beyond belong to the next part
        use = np.exp(alpha[start[mine]] + weight[mine] + beta[end[mine]] - alpha[n]) * count
        known = piece[mine] >= 0
        out += np.bincount(piece[mine][known], use[known], len(prob))
    return out


def batches_of(words: list[str], cells: int, deep: int = 0) -> list[tuple[int, int]]:
    """Ranges of words in order of length for one lattice each: up to CHARS characters and ``cells`` numbers, of which a
    word takes ``deep`` (or, with 0, one a character). One word at least."""
    out, a, chars = [], 0, 0
    for i, w in enumerate(words):
        chars += len(w)
        if i > a and (chars > CHARS or (i + 1 - a) * (deep or len(w) + 1) > cells or (len(w) > SHORT) != (len(words[a]) > SHORT)):
            out.append((a, i))
            a, chars = i, len(w)
    if words:
        out.append((a, len(words)))
    return out


class Table:
    """Piece probabilities by language: what languages have used, and by language what any other piece has."""

    def __init__(self, langs: list[str], n_pieces: int, k: np.ndarray, piece: np.ndarray, uses: np.ndarray) -> None:
        self.langs, self.n_pieces = langs, n_pieces
        total = np.bincount(k, uses, len(langs)) + SMOOTH * n_pieces
        self.rest = SMOOTH / total
        by = np.lexsort((k, piece))
        self.k, self.prob = k[by].astype(np.int32), ((uses + SMOOTH) / total[k])[by]
        self.starts = np.searchsorted(piece[by], np.arange(n_pieces + 1))

    def rows(self, pieces: np.ndarray) -> np.ndarray:
        """(pieces + 1, languages) probabilities; the last row is that of an unknown character."""
        out = np.empty((len(pieces) + 1, len(self.langs)))
        out[:-1] = self.rest
        size = self.starts[pieces + 1] - self.starts[pieces]
        at = np.repeat(self.starts[pieces] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(pieces)), size), self.k[at]] = self.prob[at]
        out[-1] = UNKNOWN
        return out

    def column(self, k: int) -> np.ndarray:
        """All pieces' probabilities in one language, and that of an unknown character."""
        out = np.full(self.n_pieces + 1, self.rest[k])
        at = np.flatnonzero(self.k == k)
        out[np.searchsorted(self.starts, at, "right") - 1] = self.prob[at]
        out[-1] = UNKNOWN
        return out


class Scorer:
    """Log-likelihoods of words under all languages, kept by word."""

    def __init__(self, pieces: list[str], table: Table) -> None:
        self.index, self.table = Pieces(pieces), table
        self.k = len(table.langs)
        self.row: dict[str, int] = {}
        self.most, self.chars = max(256, MEMORY // self.k), 0
        self.scores = np.zeros((256, self.k))

    def score(self, words: list[str]) -> np.ndarray:
        """(n, k) of marked words in order of length, all on one side of SHORT."""
        logs = len(words[-1]) > SHORT
        if len(words) == 1 and len(words[0]) > CHARS:
            return self.long(words[0])
        found = Lattice(words, self.index)
        return found.forward(self.used(found, logs), logs)[0]

    def used(self, found: Lattice, logs: bool) -> np.ndarray:
        pieces, at = np.unique(found.piece[found.piece >= 0], return_inverse=True)
        found.piece[found.piece >= 0] = at
        prob = self.table.rows(pieces)
        return np.log(prob) if logs else prob

    def long(self, word: str) -> np.ndarray:
        """One word, part by part: sums are carried over."""
        before, longest = None, self.index.longest
        for a in range(0, len(word), CHARS):
            skip = min(a, longest - 1)
            found = Lattice([word[a - skip : a + CHARS]], self.index)
            total, last = found.forward(self.used(found, True), True, before)
            before = last[:, -longest:]
        return total

    def rows(self, words: list[str]) -> np.ndarray:
        at = list(map(self.row.get, words))
        if None in at:
            self.add({w for w, i in zip(words, at) if i is None})
            at = list(map(self.row.__getitem__, words))
        return np.array(at, np.int64)

    def add(self, new: set[str]) -> None:
        words = sorted((MARK + w for w in new), key=len)
        for a, b in batches_of(words, CELLS, (self.index.longest + 1) * self.k):
            part = words[a:b]
            at = len(self.row)
            while at + len(part) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[at : at + len(part)] = self.score(part)
            self.row.update(zip((w[1:] for w in part), range(at, at + len(part))))
            self.chars += sum(map(len, part))

    def texts(self, texts: list[str]) -> np.ndarray:
        """(n, k) sums of the words' log-likelihoods."""
        cut = [t.split() for t in texts]
        own = np.repeat(np.arange(len(cut)), np.fromiter(map(len, cut), np.int64, len(cut)))
        out = np.zeros((len(texts), self.k))
        flat = [w for c in cut for w in c]
        block = max(64, min(CELLS // self.k, self.most))
        for i in range(0, len(flat), block):
            if len(self.row) > self.most or self.chars > KEYS:
                self.row.clear()
                self.chars = 0
            at = self.rows(flat[i : i + block])
            rows = self.scores[at]
            mine = own[i : i + block]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            out[mine[first]] += np.add.reduceat(rows, first, axis=0)
        return out


def learn(train: DataFrame, pieces: list[str], rounds: int = 2) -> Table:
    """Piece probabilities by language from rows of (text, lang), both not null.

    All training rows count, through counts of words by language. The driver gets, and sends out, sums by language and
    piece that the language has used.
    """

    def counted(batches):
        for b in C.slices(batches, max_bytes=16 << 20):
            found: dict[str, Counter] = defaultdict(Counter)
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[lang].update(t.lower().split())
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "word", "n"])

    words = train.select("text", "lang").mapInArrow(counted, "lang string, word string, n long")
    words = C.staged(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    index = Pieces(pieces)
    none = np.zeros(0, np.int64)
    table = Table(langs, len(pieces), none, none, np.zeros(0))
    spark = train.sparkSession
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast(table)

        def expect(batches):
            known = {x: i for i, x in enumerate(now.value.langs)}
            total: dict[int, np.ndarray] = {}
            logs: dict[int, np.ndarray] = {}
            for b in C.slices(batches, "word", 16 << 20):
                lang = np.array([known[x] for x in b.column(0).to_pylist()], np.int64)
                word = [MARK + w for w in b.column(1).to_pylist()]
                n = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                for k in np.unique(lang).tolist():
                    if k not in total:
                        if len(total) >= 64:  # languages at once
                            yield from out(total)
                            total, logs = {}, {}
                        total[k], logs[k] = np.zeros(len(pieces) + 1), np.log(now.value.column(k))
                    at = sorted(np.flatnonzero(lang == k).tolist(), key=lambda i: len(word[i]))
                    some = [word[i] for i in at]
                    for i, j in batches_of(some, CELLS):
                        if len(some[i]) > CHARS:
                            total[k] += expected_long(some[i], index, logs[k], n[at[i]])
                        else:
                            total[k] += Lattice(some[i:j], index).expected(logs[k], n[at[i:j]])
            yield from out(total)

        def out(total):
            for k, x in total.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.round(x[at], 6))], ["k", "piece", "uses"])

        sums = words.mapInArrow(expect, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum(F.col("uses").cast("decimal(28,6)")).cast("double").alias("uses"))
        got = sums.toArrow()
        table = Table(langs, len(pieces), *(got.column(c).to_numpy().astype(np.int64) for c in ("k", "piece")), got.column("uses").to_numpy())
    return table


def language_id(docs: DataFrame, train: DataFrame, model: str, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every text, learned from ``train`` (text, lang); ``keep`` names columns to carry along.

    Predictions read the text alone. Null texts and those without a letter get ``und`` and score 0, as does every text
    when there is nothing to learn from. score is the language's posterior, with equal priors. Repeated rows and null
    ids are rows like others; ties go to the first language by name.
    """
    pieces = pieces_of(model)
    known = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast((pieces, learn(known, pieces)))

    def predict(batches):
        own, table = shared.value
        names = table.langs
        scorer = Scorer(own, table) if names else None
        for b in C.slices(batches):
            raw = b.column(1).to_pylist()
            texts = [(t or "").lower() for t in raw]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if scorer:
                like = scorer.texts(texts)
                best = like.argmax(1)
                post = 1.0 / np.exp(np.minimum(like - like.max(1, keepdims=True), 0)).sum(1)
                for i, t in enumerate(texts):
                    if any(map(str.isalpha, t)):
                        pred[i], score[i] = names[best[i]], post[i]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(pred, pa.string()), pa.array(score)], ["doc_id", *keep, "lang_pred", "score"])

    carried = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *carried, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # The text to read comes second, whatever else is carried.
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(f"_{c}") for c in keep]).mapInArrow(predict, schema)


def held_out(col):
    return F.coalesce(C.crc_mod(col, 4) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that the checksum of their ids doesn't hold out; null texts and texts
    without a letter are und, null langs are not learned from, rows are documents."""
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents")
    train = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    found = language_id(docs, train, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
