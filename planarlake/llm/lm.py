"""Language-model scoring by online logistic context mixing.

A text is coded word by word, a word by yes-or-no decisions: does the word follow that followed the same words before (in
the text, or in repeated passages of the corpus)? If not, did it stand earlier in the text (then which one, by how often)? If not, does the corpus know it (then which one, by
its count, without those of the text), or is it spelt out, eight bits a byte and a space that ends it? Every decision and
every bit is predicted by several counts of hashed contexts: for the decisions what went before in the text (the word
before, lengths of matches, outcomes of the last decisions, how far the text has come), for the bits the last one to five
bytes. Their log odds are added with weights that a gate chooses, and the result is refined by an adaptive map from
(gate, log odds) to what came true.

Everything is learned from all learning documents. Weights of the decisions are learned online, batch by batch, by coding
every one of these with the counts of all others (its own words left out), those of the bits on all words that stand once,
each left out of the counts that foretell it; blocks' and tasks' weights are merged by their information. Only tables of
bounded size and sums go through the driver. Texts are scored in blocks of documents, each with the counts of its own words
and what follows at its own places. At every place the corpus foresees the word that most often followed the same three
words in learning documents, if it did twice or more. All that a text's earlier words tell is used while it is coded;
nothing is learned from others then.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import words as W

ORDERS = 6
#: Slots of the hashed bit counts, for all orders together: as many bits as the distinct contexts ask for, within these.
LEAST_BITS, MOST_BITS = 16, 22
GATES, BINS = 16, 33
#: The word that ends a text; no word has a newline.
END = b"\n"
STOP = 0x20
#: Words of texts that weights are learned from together, at most and at first; then twice as many each time.
TOGETHER, ONLINE = 200_000, 8192
#: Words of texts whose decisions are worked out at once: their arrays fit a core's caches. Only last digits depend on it.
PIECE = 1 << 15
#: Bytes of texts that are cut into words at once.
PART = 1 << 16
#: Words that must have gone before for the word that followed them then to be expected.
MATCH = 3
#: Decisions, contexts of each, and slots of a context's counts.
FOLLOWS, RECALLED, KNOWN = range(3)
CONTEXTS, SLOTS = 6, 1 << 14
#: Lengths told apart of runs of words that the corpus foresaw; also the words that following() takes.
AHEAD = 8
#: Bits of a hash of three words that chosen() asks for.
CHOSEN = 4
#: Bits of a hash of three words that count (of which CTX_BITS at most travel beside its part), and of a word that follows.
ALL_BITS, CTX_BITS, NEXT_BITS = 40, 32, 24
#: What the corpus foresees after three words.
TOLD = np.dtype([("ctx", "<u4"), ("next", "<u4"), ("n", "<u2")])
#: A block's words by their hashes, and how often the corpus has them.
WORD = np.dtype([("code", "<u8"), ("c", "<i8")])
SENT_CONTEXTS = {"part": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "times": pa.binary()}
SENT_WORDS = {"part": pa.int32(), "block": pa.int32(), "codes": pa.binary(), "counts": pa.binary(), "sizes": pa.binary(), "bytes": pa.binary()}
ANSWERS = {"part": pa.int32(), "block": pa.int32(), "told": pa.binary(), "words": pa.binary(), "sizes": pa.binary(), "bytes": pa.binary(), "n": pa.int64(), "v": pa.int64()}
NOTHING = np.uint32(0xFFFFFFFF)
#: How many words of a text the corpus weighs, for the odds that decisions also start from.
PRIORS = (50.0, 500.0, 1e9)
INPUTS = CONTEXTS + len(PRIORS) + 1
#: The same for which of a text's earlier words comes again; the best for the texts learned from is taken.
WEIGHTS = np.array([3.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 1e4, 1e6])
CHUNK = 16384


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte of the words as five bytes before it and itself in one number; and its word's position."""
    coded = [w if w == END else w + b" " for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    sym = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(coded)), size)
    at = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
    gram = sym.copy()
    for o in range(1, 6):
        before = np.full(len(sym), STOP, np.int64)
        before[o:] = sym[:-o] if o <= len(sym) else 0
        gram |= np.where(at >= o, before, STOP) << (8 * o)
    return gram, word


def slots_of(gram: np.ndarray, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 8, ORDERS) table slots and (n, 8) bits of the grams' decisions."""
    g = gram.astype(np.uint64)
    sym = (g & np.uint64(255)).astype(np.int64)
    depth = np.arange(8)
    node = ((1 << depth) | (sym[:, None] >> (8 - depth))).astype(np.uint64)
    bit = (sym[:, None] >> (7 - depth)) & 1
    out = np.empty((len(g), 8, ORDERS), np.int64)
    for o in range(ORDERS):
        ctx = (g >> np.uint64(8)) & np.uint64((1 << (8 * o)) - 1)
        h = ctx[:, None] * np.uint64(0x9E3779B97F4A7C15) + (node + np.uint64(256 * o)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, :, o] = (h >> np.uint64(64 - slot_bits)).astype(np.int64)
    return out, bit


class Tables:
    """Log odds and a measure of trust by slot, and the counts they are from."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray) -> None:
        self.bits = len(n0).bit_length() - 1
        self.n: tuple | None = (n0, n1)
        self.odds = self.trust = None

    def settle(self) -> Tables:
        """Work out what is looked up when no gram is left out."""
        n0, n1 = self.n
        self.odds = np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)
        self.trust = np.digitize(n0 + n1, [1, 4, 32]).astype(np.uint8)
        return self

    def alone(self) -> Tables:
        """Without the counts, to be sent to workers."""
        self.settle().n = None
        return self

    def inputs(self, gram: np.ndarray, left_out: bool = False):
        """(n, 8, ORDERS + 1) inputs, (n, 8) gates and bits. left_out: as if each gram had been counted once less."""
        slot, bit = slots_of(gram, self.bits)
        x = np.ones((*slot.shape[:2], ORDERS + 1))
        if left_out:
            n0, n1 = (np.maximum(n[slot] - (bit == v)[:, :, None], 0) for v, n in enumerate(self.n))
            x[:, :, :ORDERS] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
            trust = [np.digitize(n0[:, :, o] + n1[:, :, o], [1, 4, 32]) for o in (5, 3)]
            return x, trust[0] * 4 + trust[1], bit
        if self.odds is None:
            self.settle()
        x[:, :, :ORDERS] = self.odds[slot]
        gate = self.trust[slot[:, :, 5]].astype(np.int64) * 4 + self.trust[slot[:, :, 3]]
        return x, gate, bit


def squash(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def start_weights() -> np.ndarray:
    w = np.full((GATES, ORDERS + 1), 0.25)
    w[:, -1] = 0
    return w


def bins_of(z):
    return np.clip(np.round(z * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)


class Mixer:
    def __init__(self, tables: Tables, weights: np.ndarray, refined: np.ndarray | None = None) -> None:
        self.tables, self.weights, self.refined = tables, weights, refined

    def odds(self, x, gate):
        return np.einsum("ndi,ndi->nd", x, self.weights[gate])

    def log2(self, gram: np.ndarray) -> np.ndarray:
        """Bits (negative) that each gram's last byte costs after its context."""
        out = np.empty(len(gram))
        for i in range(0, len(gram), CHUNK):
            x, gate, bit = self.tables.inputs(gram[i : i + CHUNK])
            z = self.odds(x, gate)
            p = squash(z)
            if self.refined is not None:
                p = 0.5 * p + 0.5 * self.refined[gate, bins_of(z)]
            p = np.clip(p, 1e-9, 1 - 1e-9)
            out[i : i + CHUNK] = np.log2(np.where(bit == 1, p, 1 - p)).sum(1)
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability by its bytes."""
        if not words:
            return np.zeros(0)
        gram, word = grams_of(words)
        distinct, at = np.unique(gram, return_inverse=True)
        return np.bincount(word, self.log2(distinct)[at], len(words)) * np.log(2)

    def learn(self, gram: np.ndarray, n: np.ndarray, info: np.ndarray) -> None:
        """Online Newton steps, batch by batch, on grams that the tables have counted (each is left out of them); info
        (GATES, k, k) gathers what the steps rest on."""
        for i in range(0, len(gram), CHUNK // 4):
            x, gate, bit = self.tables.inputs(gram[i : i + CHUNK // 4], True)
            w = np.repeat(n[i : i + CHUNK // 4], 8)
            x, gate, bit = x.reshape(-1, ORDERS + 1), gate.ravel(), bit.ravel()
            p = squash((x * self.weights[gate]).sum(1))
            for k in np.unique(gate):
                m = gate == k
                v, q = x[m], p[m]
                info[k] += (v * (w[m] * q * (1 - q))[:, None]).T @ v
                step = np.linalg.solve(info[k], v.T @ (w[m] * (bit[m] - q)))
                self.weights[k] += step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))


def _tokens(words: W.Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of the words of texts, each text's followed by its end's, 0; each text's number of words; places of words."""
    data, offs = C.utf8(texts)
    start, end, count = words.cut(data, offs)
    return np.insert(words.hashes(data, start, end), np.cumsum(count), np.uint64(0)), count, (data, start, end)


def contexts(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in texts of the given sizes that three words went before, and hashes of these."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    if len(h) <= MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(place[MATCH:] >= MATCH)
    return at + MATCH, W.rolled(h, MATCH)[at]


def chosen(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of which the hash of the three words before begins with CHOSEN zeros, and these hashes. lm_scores does not
    choose: it takes all contexts()."""
    at, ctx = contexts(h, size)
    good = ctx >> np.uint64(64 - CHOSEN) == 0
    return at[good], ctx[good].view(np.int64)


def following(h: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(places, AHEAD) short hashes of the words from each place on; NOTHING beyond the text."""
    until = np.repeat(np.cumsum(size), size)[at]
    j = at[:, None] + np.arange(AHEAD)
    return np.where(j < until[:, None], h[np.minimum(j, len(h) - 1)].astype(np.uint32), NOTHING)


class Model:
    """What scoring needs besides the words' own counts."""

    def __init__(self, mixer: Mixer, chooser: Chooser, total: int, distinct: int) -> None:
        self.mixer, self.chooser, self.total, self.distinct = mixer, chooser, total, distinct


#: 0 for 0, then two a doubling, up to 31.
BUCKETS = np.minimum(np.concatenate(([0], 1 + (2 * np.log2(np.arange(1, (1 << 15) + 1))).astype(np.int64))), 31).astype(np.uint8)


def _bucket(n: np.ndarray) -> np.ndarray:
    return BUCKETS.take(np.minimum(n, len(BUCKETS) - 1)).astype(np.int64)


def _past(own: np.ndarray, bit: np.ndarray, k: int) -> np.ndarray:
    """The last k outcomes in the same text in one number (k at most 4: it fits a byte); 0 stands for none."""
    if not len(bit):
        return np.zeros(0, np.int64)
    # k zeros before each text.
    at = np.arange(len(bit)) + k * (own - own[0] + 1)
    padded = np.zeros(at[-1] + 1, np.uint8)
    padded[at] = bit + 1
    out = np.zeros(len(padded), np.uint8)
    for j in range(1, k + 1):
        out[j:] += padded[:-j] * np.uint8(3 ** (j - 1))
    return out.take(at).astype(np.int64)


def _again(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where hashes stand that stood before, and where they did last."""
    # Sorted with their places in the lowest bits, which is faster than argsort.
    low = np.uint64((1 << len(ctx).bit_length()) - 1)
    key = np.sort((ctx & ~low) | np.arange(len(ctx), dtype=np.uint64))
    at, same = (key & low).astype(np.int64), np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    here, there = at[same + 1], at[same]
    if (ctx[here] != ctx[there]).any():  # hashes that differ in the lowest bits only
        at = np.argsort(ctx, kind="stable")
        same = np.flatnonzero(ctx[at[1:]] == ctx[at[:-1]])
        here, there = at[same + 1], at[same]
    return here, there


def _counts(key: np.ndarray, place: np.ndarray, own: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many counted rows with the same key come before a row in its text, and how many there are at all; the row at a place
    is found at twice the place, and one more if it is counted. own: the texts of all places. By one sort of numbers that hold
    all this."""
    bits = len(own).bit_length()
    row = np.sort((key << (bits + 1)) | (place << 1) | counted)
    text = own.take((row >> 1) & ((1 << bits) - 1))
    now, key = row & 1, row >> (bits + 1)
    new = _first(key)
    new[1:] |= text[1:] != text[:-1]
    heads = np.flatnonzero(new)
    done = np.cumsum(now)
    before = done - now
    all_of = np.diff(before[heads], append=done[-1] if len(done) else 0)
    length = np.diff(heads, append=len(row))
    # By place and whether counted.
    out = np.zeros((2, 2 << bits), np.int64)
    at = row & ((2 << bits) - 1)
    out[0][at], out[1][at] = before - np.repeat(before[heads], length), np.repeat(all_of, length)
    return out


class Steps:
    """The decisions by which the words of several texts on end, of the given sizes, are coded.

    words are numbers into count (in the corpus of so many words) and code (a hash of each). Of each decision: at (which
    words), bit, slots of its contexts, gate, and log odds as the text's words and the corpus' counts together have them.
    before: how often the word stood earlier in its text; others: how many earlier words there are that it can be, if it is
    not the one that follows; seen: the share of these in the corpus; share: the word's own."""

    def __init__(self, words: np.ndarray, size: np.ndarray, count: np.ndarray, code: np.ndarray, total: int, ahead=None, left_out: bool = False) -> None:
        """left_out: each text's words are taken out of the corpus it is coded with. ahead has, for each word, the one that the corpus foresees (-1 for none, -2 for one that isn't among count), how
        many words after the chosen place it stands, and how often it followed."""
        n = len(words)
        own, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        start = np.repeat(starts, size)
        place = np.arange(n) - start

        def last(x: np.ndarray) -> np.ndarray:
            """Of the word before, 0 for none."""
            out = np.zeros_like(x)
            out[1:] = x[:-1]
            out[starts] = 0
            return out

        # The word that followed the last place where the same words went before.
        cand, src = np.full(n, -1), np.full(n, -2)
        if n > MATCH:
            ctx = own[MATCH:].astype(np.uint64)
            for k in range(MATCH, 0, -1):
                ctx = ctx * W.BASE + words[MATCH - k : n - k].astype(np.uint64)
            at = np.flatnonzero(place[MATCH:] >= MATCH)
            here, there = (at[i] + MATCH for i in _again(ctx[at] * W.BASE))
            cand[here], src[here] = words[there], there
        on = np.zeros(n, bool)
        on[1:] = (src[1:] == src[:-1] + 1) & (src[:-1] >= 0)
        length = np.minimum(np.arange(n) - np.maximum.accumulate(np.where(on, 0, np.arange(n))) + 1, 15)
        expected = cand >= 0
        # The corpus speaks where the text itself says nothing.
        far_off = np.zeros(n, bool)
        if ahead is not None:
            far_off = ~expected & (ahead[0] != -1)
            cand = np.where(far_off, ahead[0], cand)
            expected = expected | far_off
        here = expected & (cand >= 0)
        hit = here & (cand == words)
        # How often each word stood earlier, and the expected one, if it is another.
        p = np.flatnonzero(here & ~hit)
        places = np.concatenate((np.arange(n), p))
        before, own_count = (x[: 2 * n] for x in _counts(np.concatenate((words, cand[p])), places, own, np.arange(len(places)) < n))
        before, seen, own_count, cand_own = before[1::2], before[::2], own_count[1::2], own_count[::2]
        seen = np.where(hit, before, seen)
        self.own, self.start, self.before, self.count = own, start, before, count[words]
        cand_count = np.where(here, count[cand], 0) if len(count) else np.zeros(n, np.int64)
        if left_out:
            self.count = self.count - own_count
            cand_count -= np.where(hit, own_count, cand_own)
            total = total - size[own]
        self.others = place - seen
        far = _bucket(place)
        hashed = last((W.mixed(code[words]) >> np.uint64(50)).astype(np.int64))
        fresh = before == 0
        firsts = np.cumsum(fresh) - fresh
        firsts -= firsts[start]
        known = self.count > 0
        old = np.cumsum(fresh & known) - (fresh & known)
        old -= old[start]
        ratio = firsts * 15 // np.maximum(place, 1)
        was = np.minimum(before, 7)
        last_two = last(_bucket(self.count) * 8 + was)  # how often the word before stands in the corpus, and stood earlier
        self.share, cand_share = self.count / np.maximum(total, 1), cand_count / np.maximum(total, 1)
        self.hit, self.apart = hit, np.where(seen > 0, 0.0, cand_share)  # share of the expected word, if new to the text
        first_share = np.where(fresh, self.share, 0.0)
        self.gone = np.cumsum(first_share) - first_share
        self.gone -= self.gone[start]
        self.seen = np.clip(self.gone - (cand_share - self.apart), 0.0, 1.0)
        self.of = []
        for k, (mask, bit) in enumerate(((expected, hit), (~hit & (self.others > 0), ~fresh), (~hit & fresh, known))):
            at = np.flatnonzero(mask)
            b, far_at, hashed_at = bit[at].astype(np.int64), far[at], hashed[at]
            past = _past(own[at], b, 4)
            if k == FOLLOWS:
                often, ago = np.minimum(seen[at], 7), length[at]
                gate, count_ahead = ago, 0
                if ahead is not None:
                    far_off_at = far_off[at]
                    gate = np.where(far_off_at, 0, ago)
                    ago = np.where(far_off_at, 16 + ahead[1][at], ago)
                    count_ahead = np.where(far_off_at, _bucket(ahead[2][at]), 0)
                contexts = (ago, past, often * 32 + _bucket(cand_count[at]), far_at, hashed_at, count_ahead * 256 + ago * 8 + often)
            else:
                two, ratio_at, gate = last_two[at], ratio[at], far_at // 2
                if k == RECALLED:
                    contexts = (far_at, past, (two & 7) * 32 + far_at, hashed_at, ratio_at * 32 + far_at, two)
                else:
                    share = old[at] * 15 // np.maximum(firsts[at], 1)
                    contexts = (far_at, past, share * 32 + far_at, hashed_at, two, ratio_at * 16 + share)
            slots = np.empty((CONTEXTS, len(at)), np.int64)  # one context's after the other's
            for j, x in enumerate(contexts):
                np.add(x, SLOTS * (CONTEXTS * k + j), out=slots[j])
            odds = np.empty((len(PRIORS), len(at)))
            if k == FOLLOWS:
                yes, none, m_yes, m_all = seen[at], place[at], cand_share[at], 1.0
            elif k == RECALLED:
                yes = none = self.others[at]
                m_yes, m_all = self.seen[at], 1 - cand_share[at]
            else:
                yes, none = old[at], firsts[at]
            for j, m in enumerate(PRIORS):
                y, all_of = (yes + 0.8 * 4**j, none + 4**j) if k == KNOWN else (yes + m * m_yes, none + m * m_all)
                np.clip(np.log((y + 1e-9) / np.maximum(all_of - y, 1e-9)), -8, 8, out=odds[j])
            self.of.append((at, b, slots.T, gate, odds.T))


class Chooser:
    """Counts of the decisions' contexts, the weights that mix them, and the map that refines."""

    SIZE = 3 * CONTEXTS * SLOTS

    def __init__(self) -> None:
        self.n = np.zeros((2, self.SIZE))
        self.weights = np.full((3, GATES, INPUTS), 0.1)
        self.weights[:, :, CONTEXTS:-1] = 0.25
        self.weights[:, :, -1] = 0
        self.hit = np.zeros((2, 3, GATES, BINS))
        self.gain = np.zeros(len(WEIGHTS))
        self.ready = None

    @property
    def weight(self) -> float:
        return float(WEIGHTS[self.gain.argmax()]) if self.gain.any() else 300.0

    def settle(self) -> Chooser:
        """Work out what is looked up when nothing is learned any more."""
        centre = squash((np.arange(BINS) - BINS // 2) / 2)
        self.ready = np.log((self.n[1] + 0.4) / (self.n[0] + 0.4)), (self.hit[1] + 8 * centre) / (self.hit.sum(0) + 8)
        return self

    def yes(self, k: int, slots: np.ndarray, gate: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Probabilities of yes."""
        table, refined = self.ready or self.settle().ready
        w = self.weights[k].T.copy()
        z = w[-1].take(gate)
        for j in range(CONTEXTS):
            z += w[j].take(gate) * table.take(slots[:, j])
        for j in range(len(PRIORS)):
            z += w[CONTEXTS + j].take(gate) * odds[:, j]
        return np.clip(0.5 * squash(z) + 0.5 * refined[k].ravel().take(gate * BINS + bins_of(z)), 1e-6, 1 - 1e-6)

    def learn(self, steps: Steps | Iterable[Steps], info: np.ndarray) -> None:
        """An online step on what the counts so far foretell (of several Steps one together); then the counts go on."""
        self.ready = None
        size = CONTEXTS * SLOTS
        table, more, toward = np.log((self.n[1] + 0.4) / (self.n[0] + 0.4)), np.zeros_like(self.n), np.zeros((3, GATES, INPUTS))
        for s in [steps] if isinstance(steps, Steps) else steps:
            self.gain += [logs.sum() for logs in again_logs(s, *WEIGHTS)[1:]]
            for k, (_, bit, slots, gate, odds) in enumerate(s.of):
                if not len(bit):
                    continue
                # Decisions of one gate on end, inputs as rows.
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                bit, gate, slots = bit[order], gate[order], slots.T.take(order, 1)
                x = np.ones((INPUTS, len(bit)))
                x[:CONTEXTS], x[CONTEXTS:-1] = table.take(slots), odds.T.take(order, 1)
                edges = np.searchsorted(gate, np.arange(GATES + 1)).tolist()
                z = np.concatenate([self.weights[k, g] @ x[:, a:b] for g, (a, b) in enumerate(zip(edges, edges[1:]))])
                cell = (bit * GATES + gate) * BINS + bins_of(z)
                self.hit[:, k] += np.bincount(cell, minlength=2 * GATES * BINS).reshape(2, GATES, BINS)
                p = squash(z)
                off, sure = bit - p, p * (1 - p)
                for g, (a, b) in enumerate(zip(edges, edges[1:])):
                    if a < b:
                        v = x[:, a:b]
                        info[k, g] += (v * sure[a:b]) @ v.T
                        toward[k, g] += v @ off[a:b]
                slots += size * (bit - k)
                more[:, size * k : size * (k + 1)] += np.bincount(slots.ravel(), minlength=2 * size).reshape(2, size)
        for k, g in np.argwhere(toward.any(2)).tolist():
            step = np.linalg.solve(info[k, g], toward[k, g])
            self.weights[k, g] += step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        self.n += more

    def merge(self, index: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Take over the sums of what blocks have learned, as told by learned()."""
        self.ready = None
        m = self.SIZE
        at = index < m
        self.n[0][index[at]], self.n[1][index[at]] = x[at], y[at]
        at = (index >= m) & (index < m + self.hit[0].size)
        for v, c in ((0, x), (1, y)):
            self.hit[v].reshape(-1)[index[at] - m] = c[at]
        k = INPUTS
        rest = np.zeros(len(self.gain) + 3 * GATES * k * (k + 1))
        at = index >= m + self.hit[0].size
        rest[index[at] - m - self.hit[0].size] = x[at]
        self.gain, both = rest[: len(self.gain)], rest[len(self.gain) :].reshape(3, GATES, k, k + 1)
        for d in range(3):
            for g in range(GATES):
                if both[d, g].any():
                    self.weights[d, g] = np.linalg.solve(both[d, g, :, :k], both[d, g, :, k])

    def learned(self, info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, x, y) whose sums over blocks merge() takes: counts, outcomes by cell, and weights by their information."""
        both = np.concatenate((info, np.einsum("dgij,dgj->dgi", info, self.weights)[..., None]), 3).ravel()
        both = np.concatenate((self.gain, both))
        at = np.flatnonzero(self.n.any(0))
        hit = self.hit.reshape(2, -1)
        cell = np.flatnonzero(hit.any(0))
        index = np.concatenate((at, self.SIZE + cell, self.SIZE + hit.shape[1] + np.arange(len(both))))
        return index, np.concatenate((self.n[0][at], hit[0][cell], both)), np.concatenate((self.n[1][at], hit[1][cell], np.zeros(len(both))))


def again_logs(steps: Steps, *weights: float) -> tuple[np.ndarray, ...]:
    """(places, natural logs by each weight) of the words that stood earlier: which of these, by how often they did and by the corpus."""
    at = steps.of[RECALLED][0][steps.of[RECALLED][1] == 1]
    before, share, others, seen = steps.before[at], steps.share[at], steps.others[at], steps.seen[at]
    return at, *(np.log((before + m * share) / (others + m * seen)) for m in weights)


def word_logs(steps: Steps, chooser: Chooser, words: np.ndarray, spelt: np.ndarray, total: int) -> np.ndarray:
    """Natural log of each word's probability. spelt has the logs of the spellings, by number of word."""
    out = np.zeros(len(words))
    for k, (at, bit, slots, gate, odds) in enumerate(steps.of):
        if k == KNOWN and not total:
            continue  # nothing is known
        p = chooser.yes(k, slots, gate, odds)
        out[at] += np.log(np.where(bit == 1, p, 1 - p))
    at, logs = again_logs(steps, chooser.weight)
    out[at] += logs
    fresh = (steps.before == 0) & ~steps.hit
    at = np.flatnonzero(fresh & (steps.count > 0))
    out[at] += np.log(steps.count[at] / max(total, 1)) - np.log(np.maximum(1.0 - steps.gone[at] - steps.apart[at], 1e-9))
    at = np.flatnonzero((steps.before == 0) & (steps.count == 0))
    if len(at):
        own = spelt[words[at]]
        chance = np.exp(own)
        gone = np.cumsum(chance) - chance
        first = np.maximum.accumulate(np.where(_first(steps.own[at]), np.arange(len(at)), 0))  # each text's first such word
        logs = own - np.log(np.maximum(1.0 - (gone - gone[first]), 1e-9))
        out[at] += np.where(steps.hit[at], 0.0, logs)
    return out


def fit(words: DataFrame, rounds: int = 2) -> Mixer:
    """The speller of the counts of all words in learning documents (rows of words, sizes, bytes). Words that stand once are
    those that are unknown where they stand."""
    spark = words.sparkSession

    def coded(batches):
        for b in batches:
            gram, word = grams_of(_words(b.column(1), b.column(2)))
            distinct, at = np.unique(gram, return_inverse=True)
            once = C.utf8(b.column(0))[0].view(np.int64) == 1
            sums = [np.bincount(at, x, len(distinct)).astype(np.int64) for x in (None, once[word])]  # distinct words; those that stand once
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *map(pa.array, sums)], ["gram", "a", "b"])

    grams = words.select("words", "sizes", "bytes").mapInArrow(coded, "gram long, a long, b long")
    grams = C.staged(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")

    slot_bits = min(MOST_BITS, max(LEAST_BITS, (8 * grams.count()).bit_length()))

    def slotted(batches):
        size = 1 << slot_bits
        sums = np.zeros((2, size))
        for b in batches:
            gram, n = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            for i in range(0, len(gram), CHUNK):
                slot, bit = slots_of(gram[i : i + CHUNK], slot_bits)
                flat, one = slot.ravel(), np.repeat(bit.ravel(), ORDERS) == 1
                w = np.repeat(n[i : i + CHUNK], 8 * ORDERS).astype(np.float64)
                np.add.at(sums[0], flat[~one], w[~one])
                np.add.at(sums[1], flat[one], w[one])
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(sums[k, at].astype(np.int64)) for k in range(2))], ["slot", "n0", "n1"])

    slots = grams.select("gram", "a").mapInArrow(slotted, "slot int, n0 long, n1 long")
    got = slots.groupBy("slot").agg(*[F.sum(c).cast("float").alias(c) for c in ("n0", "n1")]).toArrow()
    n0, n1 = (np.zeros(1 << slot_bits, np.float32) for _ in range(2))
    at = got.column("slot").to_numpy()
    for x, c in ((n0, "n0"), (n1, "n1")):
        x[at] = got.column(c).to_numpy()
    first = spark.sparkContext.broadcast(Tables(n0, n1))
    weights = start_weights()
    k = ORDERS + 1
    for _ in range(rounds):
        now = weights

        def online(batches, now=now):
            mixer = Mixer(first.value, now.copy())
            info = np.repeat(np.eye(k)[None] * 4.0, GATES, 0)
            for b in batches:
                gram, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                order = np.random.default_rng(len(gram)).permutation(len(gram))
                mixer.learn(gram[order], n[order], info)
            both = np.concatenate((info, np.einsum("gij,gj->gi", info, mixer.weights)[:, :, None]), 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size, dtype=np.int32)), pa.array(both.ravel())], ["i", "x"])

        sums = grams.where("b > 0").select("gram", "b").mapInArrow(online, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        if sums.num_rows:
            both = np.zeros(GATES * k * (k + 1))
            both[sums.column("i").to_numpy()] = sums.column("x").to_numpy()
            both = both.reshape(GATES, k, k + 1)
            weights = np.stack([np.linalg.solve(x[:, :k], x[:, k]) for x in both])

    def refine(batches):
        mixer, hit = Mixer(first.value, weights), np.zeros((2, GATES * BINS))
        for b in batches:
            gram, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(gram), CHUNK):
                x, gate, bit = mixer.tables.inputs(gram[i : i + CHUNK], True)
                cell = (gate * BINS + bins_of(mixer.odds(x, gate))).ravel()
                w = np.repeat(n[i : i + CHUNK], 8).astype(np.float64)
                for v in (0, 1):
                    hit[v] += np.bincount(cell, w * (bit.ravel() == v), GATES * BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * BINS, dtype=np.int32)), pa.array(hit[0]), pa.array(hit[1])], ["i", "n0", "n1"])

    got = grams.where("b > 0").select("gram", "b").mapInArrow(refine, "i int, n0 double, n1 double").groupBy("i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    centre = np.tile(squash((np.arange(BINS) - BINS // 2) / 2), GATES)
    hit = np.zeros((2, GATES * BINS))
    for c in (0, 1):
        hit[c, got.column("i").to_numpy()] = got.column(f"n{c}").to_numpy()
    refined = ((hit[1] + 8 * centre) / (hit.sum(0) + 8)).reshape(GATES, BINS)
    C.discard(grams)
    first.destroy()
    return Mixer(Tables(n0, n1).alone(), weights, refined)


class Vocabulary:
    """Numbers of a block's words by their hashes, and what the corpus foresees at its places."""

    def __init__(self, code: np.ndarray, ahead: pa.Table, bits: int = 64, next_bits: int = 32) -> None:
        """code: the words' hashes; ahead: (ctx, seq, n) of contexts, of which the first bits count: the words on end that
        follow (the last next_bits of their hashes), and how often they did."""
        self.mask = np.uint32((1 << next_bits) - 1)
        self.all = code
        self.shift = np.uint64(64 - max(10, (4 * len(code)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[code >> self.shift] = np.arange(len(code))
        # Words whose slot another one took are found by their order.
        rest = np.flatnonzero(self.table[code >> self.shift] != np.arange(len(code)))
        self.order = rest[np.argsort(code[rest], kind="stable")]
        self.code = code[self.order]
        short = code.astype(np.uint32) & self.mask
        self.short_order = np.argsort(short, kind="stable")
        self.short = short[self.short_order]
        self.words = W.Words()
        self.low = np.uint64(64 - bits)
        ctx = ahead.column("ctx").to_numpy().view(np.uint64) >> self.low
        by = np.argsort(ctx, kind="stable")
        self.ctx, self.often = ctx[by], ahead.column("n").to_numpy()[by]
        # Where the last context with the same first bits stands; the others lie before it.
        self.ctx_shift = np.uint64(max(0, bits - max(10, (4 * len(by)).bit_length())))
        self.ctx_table = np.full(1 << (bits - int(self.ctx_shift)), -1, np.int32)
        self.ctx_table[self.ctx >> self.ctx_shift] = np.arange(len(by))
        seq = C.utf8(ahead.column("seq").combine_chunks())[0] if len(by) else np.zeros(0, np.uint8)
        self.seq = seq.view(np.uint32).reshape(len(by), -1)[by] if len(by) else np.zeros((0, 1), np.uint32)
        number = np.minimum(np.searchsorted(self.short, self.seq), max(0, len(self.short) - 1))
        self.told = np.where(self.short[number] == self.seq, self.short_order[number], -2) if len(by) else self.seq.astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = self.table[h >> self.shift].astype(np.int64)
        miss = np.flatnonzero(self.all[out] != h)
        out[miss] = self.order[np.searchsorted(self.code, h[miss])]
        return out

    def rows(self, ctx: np.ndarray) -> np.ndarray:
        """The row of each context, -1 for none."""
        ctx = ctx >> self.low
        slot = ctx >> self.ctx_shift
        row = self.ctx_table[slot].astype(np.int64)
        miss = np.flatnonzero(row >= 0)
        miss = miss[self.ctx[row[miss]] != ctx[miss]]
        while len(miss):
            row[miss] -= 1
            there = self.ctx[row[miss]]
            live = (row[miss] >= 0) & (there >> self.ctx_shift == slot[miss]) & (there >= ctx[miss])
            row[miss[~live]] = -1
            miss = miss[live & (there != ctx[miss])]
        return row

    def foreseen(self, h: np.ndarray, size: np.ndarray, left_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word foreseen at each place (-1 for none, -2 for one that the block doesn't have), how many words on end were
        foreseen rightly before it (AHEAD - 1 at most), and how often it followed. Of several words after contexts that have
        been right so far, the oldest context's counts. left_out: what a text tells of itself counts as one."""
        n = len(h)
        cand, age, often = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, ctx = contexts(h, size)
        if not len(self.ctx) or not len(at):
            return cand, age, often
        row = self.rows(ctx)
        good = row >= 0
        at, row = at[good], row[good]
        until, short = np.repeat(np.cumsum(size), size)[at], h.astype(np.uint32) & self.mask
        count = self.often[row].astype(np.int64)
        if left_out:
            told = self.seq[row, 0] == short[at]
            times = _counts(row, at, np.repeat(np.arange(len(size)), size), told)[1][2 * at + told]
            count -= np.maximum(times - 1, 0)
            good = count > 1
            at, row, until, count = at[good], row[good], until[good], count[good]
        right = np.zeros(n, bool)
        for k in range(self.seq.shape[1]):
            told = self.seq[row, k]
            live = (at + k < until) & (told != NOTHING)
            at, row, until, count, told = at[live], row[live], until[live], count[live], told[live]
            i = at + k
            cand[i] = self.told[row, k]
            often[i] = count
            hit = right[i] = short[i] == told
            at, row, until, count = at[hit], row[hit], until[hit], count[hit]
        wrong = np.maximum.accumulate(np.where(right, -1, np.arange(n)))
        age[1:] = np.minimum(np.arange(n - 1) - wrong[:-1], AHEAD - 1)
        return cand, np.where(cand == -1, 0, age), often

    def texts(self, texts: pa.ChunkedArray, together: int, left_out: bool = False):
        """(bytes, numbers of the words, sizes, what is foreseen, whether so many words are together) of texts, by pieces;
        twice as many words the next time, up to TOGETHER."""
        lengths, sizes, flat, n, piece = [], [], [], 0, 0

        def out():
            h, size = np.concatenate(flat), np.concatenate(sizes)
            return np.concatenate(lengths), self.numbers(h), size, self.foreseen(h, size, left_out), n > together

        for chunk in texts.chunks:
            _, offs = C.utf8(chunk)
            at = 0
            while at < len(chunk):
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + PART, "right")) - 1)
                h, count, _ = _tokens(self.words, chunk.slice(at, to - at))
                lengths.append(np.maximum(np.diff(offs[at : to + 1]), 1)), sizes.append(count + 1)
                flat.append(h)
                n, piece = n + len(h), piece + len(h)
                at = to
                if n > together or piece > PIECE:
                    yield out()
                    lengths, sizes, flat, piece = [], [], [], 0
                    if n > together:
                        n, together = 0, min(2 * together, TOGETHER)
        if sizes:
            yield out()


def _words(sizes: pa.Array, texts: pa.Array) -> list[bytes]:
    """Words of rows with their sizes and their bytes on end."""
    size, (data, _) = C.utf8(sizes)[0].view(np.uint32), C.utf8(texts)
    buf, ends = data.tobytes(), np.cumsum(size, dtype=np.int64)
    return [buf[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]


def _rows(kind: dict, n: int, /, **columns) -> pa.Table:
    return pa.table([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kind.items()], list(kind))


def _schema(kind: dict) -> str:
    return ", ".join(f"{k} {'binary' if pa.types.is_binary(t) else 'long' if t == pa.int64() else 'int'}" for k, t in kind.items())


def _edges(x: np.ndarray) -> list[int]:
    """Where runs of equal numbers begin, and the end."""
    return [*np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist(), len(x)] if len(x) else [0]


def _first(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))


def _body(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(C.utf8(x)[0] for x in table.column(column).chunks)]).view(kind)


def _parted(right: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Counts and hashes of a block's words, and its contexts (ctx, seq, n)."""
    told = right.filter(pa.compute.is_valid(right.column("told")))
    rows, words = _body(told, "told", TOLD), _body(right, "words", WORD)
    bits = right.column("bits")[0].as_py()
    part = np.repeat(told.column("part").to_numpy().astype(np.uint64), pa.compute.binary_length(told.column("told")).to_numpy() // TOLD.itemsize)
    ctx = (part << np.uint64(64 - bits)) | (rows["ctx"].astype(np.uint64) << np.uint64(64 - bits - _ctx_bits(bits)))
    seq = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * 4), pa.py_buffer(rows["next"].tobytes())])
    return words["c"].copy(), words["code"].copy(), pa.table([pa.array(ctx.view(np.int64)), seq, pa.array(rows["n"])], ["ctx", "seq", "n"])


def _release(spark: SparkSession) -> None:
    """C.release(), asked again after a second: right after a query its shuffle files are still held."""
    C.release(spark)
    time.sleep(1)
    C.release(spark)


def _ctx_bits(part_bits: int) -> int:
    """Bits of a context's hash beside those of its part."""
    return min(CTX_BITS, max(16, ALL_BITS - part_bits))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys, of contexts' bits and NEXT_BITS, as steps from context to context and what follows, byte by byte: the
    first bytes of steps are zeros, which compress."""
    step = np.diff(keys >> np.uint64(NEXT_BITS), prepend=np.uint64(0)).astype(np.uint32)
    after = (keys & np.uint64((1 << NEXT_BITS) - 1)).astype(np.uint32)
    return step.view(np.uint8).reshape(-1, 4).T.tobytes() + after.view(np.uint8).reshape(-1, 4)[:, : NEXT_BITS // 8].T.tobytes()


def _unpacked(body: np.ndarray) -> np.ndarray:
    """The contexts' bits above 32 of what follows."""
    planes = body.reshape(4 + NEXT_BITS // 8, -1)
    step = np.ascontiguousarray(planes[:4].T).view(np.uint32)[:, 0]
    after = np.zeros((planes.shape[1], 4), np.uint8)
    after[:, : NEXT_BITS // 8] = planes[4:].T
    return (np.cumsum(step, dtype=np.uint64) << np.uint64(32)) | after.view(np.uint32)[:, 0]


def gathered(dealt: DataFrame, part_bits: int) -> tuple[DataFrame, DataFrame]:
    """What the corpus tells blocks of texts (block, fold, text), in ANSWERS. First, of all contexts of a block, the word
    that followed most often in learning documents, if it did twice or more. Second, the counts of all its words (by their
    hashes; those that learning documents don't have also by their bytes), and, without a block, all words of learning
    documents with their counts, their sum n and number v.

    Every place of every text takes part. A block sends each part (by the first bits of the hashes) its distinct contexts
    with what followed and how often, and its words; the part sums them up and answers the block what it has."""
    low, after = np.uint64((1 << 32) - 1), np.uint64((1 << NEXT_BITS) - 1)
    ctx_bits = _ctx_bits(part_bits)

    def sent_contexts(batches):
        words = W.Words()
        for x in C.slices(batches, max_bytes=3 << 20):
            block, fold = (x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            blocks, of = np.unique(block, return_inverse=True)
            h, count, _ = _tokens(words, x.column(2))
            at, ctx = contexts(h, count + 1)
            text = np.repeat(np.arange(len(count)), count + 1)[at]
            known = fold[text] != 1
            # Texts that are only scored just ask.
            key = ((ctx << np.uint64(part_bits)) >> np.uint64(64 - ctx_bits) << np.uint64(NEXT_BITS)) | np.where(known, h[at] & after, np.uint64(0))
            to = ((of[text] * 2 + known) << part_bits) + (ctx >> np.uint64(64 - part_bits)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if 2 * len(blocks) << part_bits <= 1 << 16 else to, kind="stable")
            to, key = to[order], key[order]
            edges, keys, times = _edges(to), [], []
            for a, b in zip(edges, edges[1:]):
                k = np.sort(key[a:b])
                first = np.flatnonzero(_first(k))
                keys.append(_packed(k[first]))
                times.append((np.diff(first, append=len(k)) * bool(to[a] >> part_bits & 1)).astype(np.uint32).tobytes())
            to = to[edges[:-1]]
            yield from _rows(SENT_CONTEXTS, len(to), part=to & ((1 << part_bits) - 1), block=blocks[to >> part_bits + 1], keys=keys, times=times).to_batches()

    def sent_words(batches):
        words = W.Words()
        for x in C.slices(batches, max_bytes=3 << 20):
            block, fold = (x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            blocks, of = np.unique(block, return_inverse=True)
            h, count, (data, start, end) = _tokens(words, x.column(2))
            text = np.repeat(np.arange(len(count)), count + 1)
            # Mostly a task has one block.
            order = np.argsort(h) if len(blocks) == 1 else np.lexsort((h, of[text]))
            to = (of[text[order]] << part_bits) + (h[order] >> np.uint64(64 - part_bits)).astype(np.int64)
            first = np.flatnonzero(_first(h[order]) | _first(to))
            one, to = order[first], to[first]
            n = np.add.reduceat((fold != 1)[text[order]], first, dtype=np.int64)
            # Places of the words that stand for their likes; ends have none.
            is_end, place = h[one] == 0, one - text[one]
            body = [np.where(is_end, 0, y[np.where(is_end, 0, place)]) if len(y) else np.zeros(len(one), np.int64) for y in (start, end)]
            body, offs = C.utf8(pa.compute.if_else(pa.array(is_end), pa.scalar(END, pa.binary()), W.lowered(data, *body)))
            size, edges, code = np.diff(offs).astype(np.uint32), _edges(to), h[one]
            cut = lambda y: [y[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            texts = [body[offs[a] : offs[b]].tobytes() for a, b in zip(edges, edges[1:])]
            to = to[edges[:-1]]
            yield from _rows(SENT_WORDS, len(to), part=to & ((1 << part_bits) - 1), block=blocks[to >> part_bits], codes=cut(code), counts=cut(n), sizes=cut(size), bytes=texts).to_batches()

    def foretold(rows: pa.Table) -> pa.Table:
        part, times = rows.column("part")[0].as_py(), _body(rows, "times", np.uint32)
        body, size = _body(rows, "keys", np.uint8), pa.compute.binary_length(rows.column("keys")).to_numpy()
        ends = np.cumsum(size, dtype=np.int64)
        keys = np.concatenate([_unpacked(body[b - n : b]) for b, n in zip(ends.tolist(), size.tolist())])
        block = np.repeat(rows.column("block").to_numpy(), size // (4 + NEXT_BITS // 8))
        order = np.argsort(keys)
        key = keys[order]
        new = _first(key)
        first = np.flatnonzero(new)
        n, pair = np.add.reduceat(times[order], first, dtype=np.int64), key[first]
        ctx = np.cumsum(_first(pair >> np.uint64(32))) - 1
        # Of each context the word that followed most often; among such, the largest hash.
        good = np.flatnonzero(n > 1)
        good = good[np.lexsort((n[good], ctx[good]))]
        good = good[np.concatenate((ctx[good[1:]] != ctx[good[:-1]], np.ones(min(1, len(good)), bool)))]
        best = np.full(len(first), -1)
        best[ctx[good]] = np.arange(len(good))
        mine = best[ctx[np.cumsum(new) - 1]]
        asked = mine >= 0
        block, mine = np.divmod(np.unique(block[order[asked]].astype(np.int64) * max(1, len(good)) + mine[asked]), max(1, len(good)))
        out = np.zeros(len(good), TOLD)
        out["ctx"], out["next"], out["n"] = pair[good] >> np.uint64(32), pair[good] & low, np.minimum(n[good], (1 << 16) - 1)
        edges = _edges(block)
        told = [out[mine[a:b]].tobytes() for a, b in zip(edges, edges[1:])]
        return _rows(ANSWERS, len(told), part=np.full(len(told), part), block=block[edges[:-1]], told=told)

    def counted(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        code, counts, size, body = (_body(rows, c, t) for c, t in (("codes", np.uint64), ("counts", np.int64), ("sizes", np.uint32), ("bytes", np.uint8)))
        block = np.repeat(rows.column("block").to_numpy(), pa.compute.binary_length(rows.column("codes")).to_numpy() // 8)
        ends = np.cumsum(size, dtype=np.int64)
        order = np.lexsort((block, code))
        new = _first(code[order])
        first = np.flatnonzero(new)
        n = np.add.reduceat(counts[order], first)
        # A block has each of its words once, however many rows told of it.
        keep = np.flatnonzero(new | _first(block[order]))
        keep = keep[np.argsort(block[order[keep]], kind="stable")]
        own = np.zeros(len(keep), WORD)
        own["code"], own["c"] = code[order[keep]], n[np.cumsum(new)[keep] - 1]

        def spelt(at: np.ndarray) -> tuple[bytes, bytes]:
            offs = np.cumsum(size[at], dtype=np.int64)
            return size[at].tobytes(), body[np.repeat(ends[at] - offs, size[at]) + np.arange(offs[-1] if len(at) else 0)].tobytes()

        out: list[list] = [[], [], []]
        block, keep = block[order[keep]], order[keep]
        edges = _edges(block)
        for a, b in zip(edges, edges[1:]):
            for y, z in zip(out, (own[a:b].tobytes(), *spelt(keep[a:b][own["c"][a:b] == 0]))):
                y.append(z)
        mine = _rows(ANSWERS, len(out[0]), part=np.full(len(out[0]), part), block=block[edges[:-1]], words=out[0], sizes=out[1], bytes=out[2])
        learnt = n > 0
        sizes, texts = spelt(order[first[learnt]])
        every = _rows(ANSWERS, 1, part=[part], words=[n[learnt].tobytes()], sizes=[sizes], bytes=[texts], n=[int(n.sum())], v=[int(learnt.sum())])
        return pa.concat_tables([mine, every])

    told = dealt.select("block", "fold", "text").mapInArrow(sent_contexts, _schema(SENT_CONTEXTS))
    told = C.staged(told.groupBy("part").applyInArrow(foretold, _schema(ANSWERS)).select("part", "block", "told"), "passages")
    # One exchange after the other, not to have both on disk.
    _release(dealt.sparkSession)
    words = dealt.select("block", "fold", "text").mapInArrow(sent_words, _schema(SENT_WORDS))
    return told, C.staged(words.groupBy("part").applyInArrow(counted, _schema(ANSWERS)).drop("told"), "words")


def choose(dealt: DataFrame, answers: DataFrame, total: int, bits: int) -> Chooser:
    """What decisions are like, learned online on texts (block, text), each left out of what the answers tell its block."""

    def online(left: pa.Table, right: pa.Table) -> pa.Table:
        (c, code, ahead), chooser = _parted(right), Chooser()
        info = np.tile(np.eye(INPUTS) * 4.0, (3, GATES, 1, 1))
        pieces = Vocabulary(code, ahead, bits, NEXT_BITS).texts(left.column("text"), ONLINE, True)

        def together(piece):
            """What is learned from at once, one piece after the other."""
            while piece:
                _, i, size, foreseen, full = piece
                yield Steps(i, size, c, code, total, foreseen, True)
                piece = None if full else next(pieces, None)

        for piece in pieces:
            chooser.learn(together(piece), info)
        index, x, y = chooser.learned(info)
        return pa.table([pa.array(index.astype(np.int32)), pa.array(x), pa.array(y)], ["i", "x", "y"])

    schema = "i int, x double, y double"
    got = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(online, schema).groupBy("i").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow()
    out = Chooser()
    # Sums of floats depend on their order in the last digits; rounded, reruns agree.
    index, x, y = got.column("i").to_numpy(), np.round(got.column("x").to_numpy(), 6), np.round(got.column("y").to_numpy(), 6)
    if len(index):
        out.merge(index, x, y)
    out.weights = np.round(out.weights, 5)
    return out.settle()


def lm_scores(docs: DataFrame, fold, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text.

    ``fold`` is a column: documents with fold 1 are only scored; all others are learned from, for counts
    and weights alike. Null texts are empty: their one token is the end. Scores are log10 probabilities of the lower-cased
    words and the end. Repeated rows are scored and counted each. With nothing to learn from, every token is unknown. Ties don't arise; other columns are not read; an empty table gives an empty result.
    """
    blocks = C.parts_for(docs, 12)
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(fold, F.lit(-1)).cast("int").alias("fold"), docs[text_col].alias("text"))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    part_bits = blocks.bit_length() + 1
    bits = part_bits + _ctx_bits(part_bits)
    dealt = d.repartition(blocks, "block")
    ahead, words = gathered(dealt, part_bits)
    _release(docs.sparkSession)
    every = words.where("block is null")
    sums = every.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = sums.n or 0, sums.v or 0
    answers = words.where("block is not null").unionByName(ahead, allowMissingColumns=True).withColumn("bits", F.lit(part_bits))
    chooser = choose(dealt.where("fold <> 1").select("block", "text"), answers.select("part", "block", "told", "words", "bits"), total, bits)
    _release(docs.sparkSession)
    mixer = fit(every)
    _release(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(mixer, chooser, total, distinct))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model.value
        c, code, ahead = _parted(right)
        base, spelt = np.log10((c + 0.5) / (m.total + 0.5 * (m.distinct + 1))), np.zeros(len(c))
        unknown = np.flatnonzero(c == 0)
        spelt[unknown] = m.mixer.words([w for a, b in zip(right.column("sizes").chunks, right.column("bytes").chunks) for w in _words(a, b)])
        rows: list[list] = [[] for _ in range(6)]
        for lengths, i, size, foreseen, _ in Vocabulary(code, ahead, bits, NEXT_BITS).texts(left.column("text"), TOGETHER):
            starts = np.cumsum(size) - size
            s = np.add.reduceat(word_logs(Steps(i, size, c, code, m.total, foreseen), m.chooser, i, spelt, m.total), starts) / np.log(10)
            new = (size, np.add.reduceat((c[i] > 0).astype(np.int64), starts), np.full(len(size), m.total), np.add.reduceat(base[i], starts), s, -s * np.log2(10) / lengths)
            for r, x in zip(rows, new):
                r.extend(x.tolist())
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        return pa.table([left.column("doc_id"), left.column("fold"), *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "fold", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    schema = f"doc_id {kind}, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.select("block", "doc_id", "fold", "text").groupBy("block").cogroup(answers.select("part", "block", "told", "words", "sizes", "bytes", "bits").groupBy("block")).applyInArrow(score, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lm_scores of all documents, held out by the checksum of their ids; null texts are the end alone, rows are documents."""
    out = lm_scores(C.table(spark, sf_dir, "documents"), C.crc_mod(F.col("doc_id"), 5))
    return out.select("doc_id", (F.col("fold") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLES: dict[str, str] = {}
