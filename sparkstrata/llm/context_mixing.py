"""Language-model scores by online logistic context mixing.

Every token is a run of binary decisions. First comes whether the token repeats
the one before. If not, a Huffman code over the commonest training words (and
the end of a document and an escape for all other words) is followed bit by bit;
after an escape the word is spelled in bytes, each eight bits from the top, up to
a blank. A spelled word's probability is mixed with its share of the training
tokens outside the code: the exact count less a discount, which all discounts
together leave for the spelling.

A bit of the code has several predictors, each the counts of ones and zeros that
training found in a slot chosen by hashing a context with the node of the code:
no context, the word before, the two words before, and the last very common
word (which tells the language); one more counts the nodes in the document so
far. Their log-odds are mixed by weights that the node's depth and the strength
of the two-word slot choose (the gate), and p = sigmoid(weights . log-odds). The
weights are refined online, in every document after its first 32 bits, the next
32, 64 and so on: in training from the bits seen so far, in scoring from the
start of the document on, so a score depends on the document and the trained
model alone. Documents run side by side, as the lanes of one vector. The bits of
spelled words have predictors for two, three and five bytes before, mixed by
fixed-size gated weights too.

Training gathers exact counts of all words and the slots of all training
documents from every task; what is broadcast has a fixed size. Each task refines
weights of its own and the means are kept, so scores depend on how rows are dealt
to tasks, though counts and base scores don't. Blocks grow from 32 bits to 8,192,
with one step of the weights after each, so long documents refine in steps that
lag more and more.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstrata.llm.common import arrow_schema, id_text, materialize, mix, n_partitions, record_batch, runs, sliced

#: Words of the code; most words whose exact counts every task holds.
CODE_WORDS = 8190
HELD_WORDS = 1 << 18
#: A task merges the word counts that it has gathered over so many.
MOST_KINDS = 2_000_000
#: Slots of each predictor's table.
SLOTS = 1 << 19
SPELL_SLOTS = 1 << 19
#: Last words of a context are among so many of the commonest.
COMMON = 64
N_CONTEXTS = 4  # predictors with slots; the document's own counts are one more
N_DEPTHS = 16
#: Bits of a document after which it refines its weights first, and most bits between two times.
FIRST_BLOCK, LAST_BLOCK = 32, 8192
#: Steps of the weights of a document that is scored, and of training, where many documents make one step.
RATE, TRAIN_RATE = 0.02, 0.01
#: What a word's count outside the code gives up for the spelling.
DISCOUNT = 0.6
#: Prior chance that a token repeats the one before.
REPEAT = (1.0, 400.0)

U = np.uint64
U32 = np.uint32
MASK7 = 2


def held_out():
    """Documents that training leaves out: crc32 of doc_id as text leaves 2 by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == MASK7, F.lit(False))


#: Random odd weights of bytes and of the places in a word.
BYTE_WEIGHTS = mix(np.arange(1, 257, dtype=U) << U(32)) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


class Words:
    """The words of texts, A-Z lower-cased: their hashes, places and the number in each text.

    A word's hash is the sum of the products of its bytes' and its places'
    weights, mixed.
    """

    places = mix(np.arange(1, 4097, dtype=U)) | U(1)

    def __init__(self, texts: pa.Array):
        own = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = own.buffers()
        offsets = np.frombuffer(offsets, np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64) if len(own) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        inside = ~BLANK[data]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < offsets[1:]]
        new[cut] = inside[cut]
        self.starts = np.flatnonzero(new)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut[1:] - 1] = inside[cut[1:] - 1]
        self.sizes = np.flatnonzero(last) + 1 - self.starts
        self.text_bytes = np.diff(offsets)
        self.per_text = np.diff(np.searchsorted(self.starts, offsets))
        self.data = LOWER[data]
        first = np.cumsum(self.sizes) - self.sizes
        bytes_ = self.data[inside]
        place = np.arange(len(bytes_)) - np.repeat(first, self.sizes)
        if len(place) and (longest := int(self.sizes.max())) > len(Words.places):
            Words.places = mix(np.arange(1, 2 * longest + 1, dtype=U)) | U(1)
        products = BYTE_WEIGHTS[bytes_] * Words.places[place]
        self.hash = mix(np.add.reduceat(products, first) + self.sizes.astype(U)) if len(first) else np.zeros(0, U)

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some words."""
        data = self.data.tobytes()
        return [data[a : a + n] for a, n in zip(self.starts[which].tolist(), self.sizes[which].tolist())]


class Vocabulary:
    """The distinct words of a batch of texts as numbers, with what is known of each."""

    def __init__(self, model: "Model"):
        self.model = model

    def number(self, texts: pa.Array, spell: bool = True) -> list[np.ndarray]:
        """The words of each text as numbers; what is known of the texts before is dropped."""
        self.words = Words(texts)
        self.hash, self.first, at = np.unique(self.words.hash, return_index=True, return_inverse=True)
        self.leaf, self.count = self.model.known(self.hash)
        if spell:
            self.spelled = np.zeros(len(self.hash))
            rare = np.flatnonzero(self.leaf == self.model.escape)
            if len(rare):
                self.spelled[rare] = self.model.spelling.costs(self.words.spelled(self.first[rare]))
                held = rare[self.count[rare] >= 0]
                self.spelled[held] = self.model.with_count(self.spelled[held], self.count[held])
        return np.split(at.astype(np.int32), np.cumsum(self.words.per_text)[:-1]) if len(texts) else []


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits): the path of each leaf from the root, laid end to end."""
    n = len(weights)
    heap = [(float(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, bit = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.int8)
    nxt = n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = nxt
        bit[y] = 1
        heapq.heappush(heap, (a + b, nxt))
        nxt += 1
    root = nxt - 1
    offsets, nodes, bits = [0], [], []
    for leaf in range(n):
        path = []
        k = leaf
        while k != root:
            path.append((int(parent[k]) - n, int(bit[k])))
            k = int(parent[k])
        path.reverse()
        nodes += [x for x, _ in path]
        bits += [x for _, x in path]
        offsets.append(len(nodes))
    return np.array(offsets, np.int64), np.array(nodes, np.int32), np.array(bits, np.int8)


def _spread(x: np.ndarray) -> np.ndarray:
    """Mixes 32-bit values."""
    x = x * U32(0x9E3779B1)
    x ^= x >> U32(15)
    x *= U32(0x2C1B3C6D)
    return x ^ (x >> U32(13))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of spans of the given sizes, laid end to end."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start - (upto - size), size)


@lru_cache(1 << 16)
def _no_repeats(n: int) -> float:
    """Log probability that none of ``n`` tokens repeats the one before: a ratio of gamma functions."""
    a, b = sum(REPEAT), REPEAT[1]
    return math.lgamma(n + b) - math.lgamma(b) - math.lgamma(n + a) + math.lgamma(a)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of counts, drawn towards 0 where there are few."""
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


class Spelling:
    """Bits of words in bytes from two, three and five bytes before."""

    BACK = (2, 3, 5)
    ORDERS = len(BACK)
    WEIGHTS = 8

    def __init__(self, zeros: np.ndarray | None = None, ones: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.zeros = np.zeros((self.ORDERS, SPELL_SLOTS), np.float32) if zeros is None else zeros
        self.ones = np.zeros((self.ORDERS, SPELL_SLOTS), np.float32) if ones is None else ones
        self.weights = np.full((self.WEIGHTS, self.ORDERS), 0.4, np.float32) if weights is None else weights
        self.stretch = None

    @staticmethod
    def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, starts): each byte with the five before it as one number, a blank after each word."""
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(U)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(starts, size)
        codes = data.copy()
        for k in range(1, 6):
            back = np.zeros(len(data), U)
            back[k:] = data[:-k]
            back[place < k] = 0
            codes |= back << U(8 * k)
        return codes, starts

    @staticmethod
    def events(codes: np.ndarray):
        """For each bit of the codes' last byte: (slots of each order, bit)."""
        byte = (codes & U(255)).astype(U32)
        contexts = [mix(((codes >> U(8)) & U((1 << 8 * o) - 1)) + U(o << 56)).astype(U32) for o in Spelling.BACK]
        for k in range(8):
            node = _spread((byte | U32(256)) >> U32(8 - k))
            bit = (byte >> U32(7 - k)) & U32(1)
            slots = [((c ^ node) & U32(SPELL_SLOTS - 1)).astype(np.int64) for c in contexts]
            yield k, slots, bit.astype(np.float32)

    def mixed(self, k: int, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.weights[k] @ x, -12, 12)))
        return np.clip(p, 1e-5, 1 - 1e-5)

    def learn(self, words: list[bytes], times: np.ndarray) -> None:
        """Predict the bits of words from what is known so far, refine the weights, then count them."""
        codes, starts = self.grams(words)
        size = np.diff(np.append(starts, len(codes)))
        kinds, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, np.repeat(times.astype(float), size)).astype(np.float32)
        for k, slots, bit in self.events(kinds):
            x = np.stack([_odds(self.zeros[o][s], self.ones[o][s]) for o, s in enumerate(slots)])
            for _ in range(2):
                p = self.mixed(k, x)
                self.weights[k] += RATE * 4 * (x @ ((bit - p) * n)) / n.sum()
            one = n * bit
            for o, s in enumerate(slots):
                np.add.at(self.ones[o], s, one)
                np.add.at(self.zeros[o], s, n - one)
        self.stretch = None

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word and the blank after it."""
        if self.stretch is None:
            self.stretch = _odds(self.zeros, self.ones)
        codes, starts = self.grams(words)
        kinds, at = np.unique(codes, return_inverse=True)
        cost = np.zeros(len(kinds))
        for k, slots, bit in self.events(kinds):
            p = self.mixed(k, np.stack([self.stretch[o][s] for o, s in enumerate(slots)]))
            cost += np.log(np.where(bit > 0, p, 1 - p))
        return np.add.reduceat(cost[at], starts)


class Model:
    """Code, tables and weights. Its size is bounded by the constants above, whatever the corpus."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, documents: int):
        """``hashes``, ``counts``: the commonest words; n tokens and v distinct ones, ends included."""
        order = np.lexsort((hashes, -counts))
        own = order[:CODE_WORDS]
        rest = max(n - documents - int(counts[own].sum()), 1)
        self.rest, self.rest_kinds = rest, max(v - 1 - len(own), 0)
        self.n, self.v, self.documents = n, v, documents
        self.end, self.escape = len(own), len(own) + 1
        weights = np.concatenate([counts[own], [max(documents, 1), rest]]).astype(float)
        self.offsets, nodes, bits = huffman(weights)
        depth = np.arange(len(nodes)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        self.nodes, self.signs, self.gates = nodes.astype(np.int64), bits.astype(np.float32) * 2 - 1, np.minimum(depth, N_DEPTHS - 1) * 2
        self.spread = (_spread(nodes.astype(U32)) & U32(SLOTS - 1)).astype(np.int64)
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        leaf = np.full(len(hashes), self.escape, np.int32)
        leaf[own] = np.arange(len(own))
        self.leaves = leaf[by]
        self.zeros = np.zeros((N_CONTEXTS, SLOTS), np.float32)
        self.ones = np.zeros((N_CONTEXTS, SLOTS), np.float32)
        self.weights = np.tile(np.array([0.3, 0.3, 0.15, 0.3, 0.1], np.float32)[:, None], (1, N_DEPTHS * 2))
        self.spelling = Spelling()
        self.stretch: np.ndarray | None = None

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, exact training counts) of words; the escape and -1 for those that aren't held."""
        at, known = self._place(h)
        if not len(self.hashes):
            return np.full(len(h), self.escape, np.int32), np.full(len(h), -1, np.int64)
        return np.where(known, self.leaves[at], self.escape).astype(np.int32), np.where(known, self.counts[at], -1)

    def steps(self, leaves: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Events of documents laid end to end: (rows of node, bit as -1 or 1 and gate, slots of each context, first event of each document).

        ``leaves`` are the tokens' leaves, each document's end included; ``words``
        their numbers, by which repeats are told, below 0 for an end, which is
        never a repeat; ``starts`` the first token of each document.
        """
        n = len(leaves)
        first_of = np.repeat(starts, np.diff(np.append(starts, n)))
        index = np.arange(n)
        same = np.zeros(n, bool)
        same[1:] = (words[1:] == words[:-1]) & (words[1:] >= 0)
        prev = np.full(n, self.end, U32)
        prev[1:] = leaves[:-1]
        prev[starts] = self.end
        prev2 = np.full(n, self.end, U32)
        prev2[1:] = prev[:-1]
        prev2[starts] = self.end
        last = np.full(n, -1)
        last[1:] = np.maximum.accumulate(np.where(leaves < COMMON, index, -1))[:-1]
        topic = np.where(last >= first_of, leaves[last], COMMON).astype(U32)
        new = np.flatnonzero(~same)
        first = self.offsets[leaves[new]]
        size = self.offsets[leaves[new] + 1] - first
        upto = np.cumsum(size)
        at = np.repeat(first - (upto - size), size)
        at += np.arange(len(at))
        node, spread = self.nodes[at], self.spread[at]
        slots = [node]
        for salt, context in ((1 << 20, prev), (2 << 20, prev * U32(8209) + prev2), (3 << 20, topic)):
            own = np.repeat((_spread(context[new] + U32(salt)) & U32(SLOTS - 1)).astype(np.int64), size)
            own ^= spread
            slots.append(own)
        return (node, self.signs[at], self.gates[at]), slots, np.append(0, upto)[np.searchsorted(new, starts)]

    @staticmethod
    def repeats(words: np.ndarray) -> float:
        """Log probability of which of a document's tokens repeat the one before, by counts so far, apart for what follows a repeat."""
        same = np.zeros(len(words) + 1, bool)
        same[1:-1] = words[1:] == words[:-1]
        if not same.any():
            return float(_no_repeats(len(same)))
        after = np.append(False, same[:-1])
        total = 0.0
        for kind in (False, True):
            s = same[after == kind]
            k = np.arange(len(s))
            p = (np.cumsum(s) - s + 1) / (k + 2) if kind else (np.cumsum(s) - s + REPEAT[0]) / (k + sum(REPEAT))
            total += float(np.log(np.where(s, p, 1 - p)).sum())
        return total

    def run(self, odds: np.ndarray, weights: np.ndarray, node: np.ndarray, sign: np.ndarray, gates: np.ndarray, slots: list[np.ndarray], firsts: np.ndarray, carry: bool = False) -> np.ndarray:
        """Log probability of the events of each document, whose first events are ``firsts``.

        After each block a document refines a copy of the ``weights`` of its own;
        with ``carry`` all refine ``weights`` itself, after their last blocks too.
        """
        n_docs, n_nodes, n_gates = len(firsts), len(self.offsets), weights.shape[1]
        size = np.diff(np.append(firsts, len(node)))
        own = np.full(2 * n_nodes * n_docs, 0.4, np.float32)  # nodes with zeros and with ones of each document so far
        if not carry:
            weights = np.tile(weights, n_docs)
        total, at, block = np.zeros(n_docs), 0, FIRST_BLOCK
        while (lanes := np.flatnonzero(size > at)).size:
            n = np.minimum(size[lanes] - at, block)
            s, lane = _spans(firsts[lanes] + at, n), np.repeat(lanes, n)
            nd, b = node[s], sign[s]
            x = [odds[k][slots[k][s]] for k in range(N_CONTEXTS)]
            nd += lane * (2 * n_nodes)
            if at:  # before that a document's own counts say nothing: log-odds 0
                x.append(np.log(own[nd + n_nodes] / own[nd]))
            gate = gates[s] + (np.abs(x[2]) > 1)
            if not carry:
                gate += lane * n_gates
            z = weights[0][gate] * x[0]
            for k in range(1, len(x)):
                z += weights[k][gate] * x[k]
            z *= b
            np.clip(z, -11.5, 11.5, out=z)
            against = np.exp(-z)
            total -= np.bincount(lane, np.log1p(against), n_docs)
            at += block
            block = min(2 * block, LAST_BLOCK)
            if not carry:
                on = np.repeat(size[lanes] > at, n)  # what is refined after a last block is never used
                if not on.all():
                    gate, nd, b, against, *x = (v[on] for v in (gate, nd, b, against, *x))
            error = against / (1 + against) * b * ((TRAIN_RATE if carry else RATE) / np.sqrt(np.bincount(gate, minlength=weights.shape[1]) + 16.0)).astype(np.float32)[gate]
            for k in range(len(x)):
                weights[k] += np.bincount(gate, error * x[k], weights.shape[1]).astype(np.float32)
            np.add.at(own, nd + (b > 0) * n_nodes, np.float32(1))
        return total

    def with_count(self, spelled: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log probability of words after the escape from that of their spelling and their exact training count."""
        left = max(DISCOUNT * self.rest_kinds / self.rest, 1e-3)
        full = max(1.0, (self.rest - DISCOUNT * self.rest_kinds) / self.rest + left)  # so that all shares add up to 1 at most
        return np.log((np.maximum(count - DISCOUNT, 0) / self.rest + np.exp(spelled) * left) / full)

    def ready(self) -> None:
        self.stretch = np.stack([_odds(self.zeros[k], self.ones[k]) for k in range(N_CONTEXTS)])

    def _ends(self) -> float:
        """Log probability of an end alone."""
        events, slots, firsts = self.steps(np.array([self.end]), np.array([-1]), np.array([0]))
        return float(self.run(self.stretch, self.weights, *events, slots, firsts)[0])

    def log_p(self, documents: list[np.ndarray], vocabulary: Vocabulary) -> list[float]:
        """Natural log probability of each document (word numbers) and its end, without the spelled words whose counts aren't held."""
        out = []
        for group in _together(documents):
            tokens, starts = _joined(group)
            if not len(vocabulary.leaf):
                out += [self._ends() + self.repeats(w) for w in group]
                continue
            leaves = np.where(tokens < 0, self.end, vocabulary.leaf[tokens])
            events, slots, firsts = self.steps(leaves, tokens, starts)
            held = (leaves == self.escape) & (vocabulary.count[tokens] >= 0)
            held[1:] &= tokens[1:] != tokens[:-1]
            spelled = np.add.reduceat(np.where(held, vocabulary.spelled[tokens], 0.0), starts)
            totals = self.run(self.stretch, self.weights, *events, slots, firsts)
            out += [total + self.repeats(words) + more for words, total, more in zip(group, totals.tolist(), spelled.tolist())]
        return out


def _together(documents: list[np.ndarray], most: int = 16384) -> Iterator[list[np.ndarray]]:
    """Documents in groups of some thousand words."""
    group, n = [], 0
    for words in documents:
        group.append(words)
        n += len(words) + 1
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def _joined(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of documents end to end, -1 at each end, and the start of each."""
    size = np.array([len(w) + 1 for w in group])
    ends = np.cumsum(size)
    tokens = np.full(int(ends[-1]), -1, np.int32)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = np.concatenate(group)
    return tokens, ends - size


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


def _packed(h: np.ndarray, bits: int, columns: dict[str, np.ndarray], schema: pa.Schema, fixed: dict) -> pa.RecordBatch | None:
    """A row for each leading ``bits`` of sorted hashes, with packed columns."""
    cut = np.searchsorted(_part(h, bits), np.arange((1 << bits) + 1))
    rows: dict[str, list] = {k: [] for k in schema.names}
    for p in range(1 << bits):
        if cut[p] < cut[p + 1]:
            for k in rows:
                rows[k].append(p if k == "part" else columns[k][cut[p] : cut[p + 1]].tobytes() if k in columns else fixed.get(k))
    return record_batch(rows, schema) if rows["part"] else None


def _grouped(batches: Iterator[pa.RecordBatch]):
    """(key, concatenated packed columns) of rows sorted by their first column."""
    key, cols = None, None
    for b in batches:
        keys = b.column(0).to_pylist()
        blobs = [b.column(k).to_pylist() for k in range(1, b.num_columns)]
        for k, p in enumerate(keys):
            if p != key:
                if key is not None:
                    yield key, [np.frombuffer(b"".join(c), np.uint8) for c in cols]
                key, cols = p, [[] for _ in blobs]
            for c, x in zip(cols, blobs):
                c.append(x[k])
    if key is not None:
        yield key, [np.frombuffer(b"".join(c), np.uint8) for c in cols]


def count_words(docs: DataFrame, bits: int) -> DataFrame:
    """(part, n, total, hash, count): exact counts of all words of ``docs`` (lower-cased), grouped by the hashes' leading bits."""
    n = n_partitions(docs.sparkSession)
    schema = arrow_schema("part long, hash binary, count binary")

    def local(batches):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, c = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            order = np.argsort(h)
            at = runs(h[order])[:-1]
            return h[order][at], np.add.reduceat(c[order], at)

        for b in sliced(batches):
            h, c = np.unique(Words(b.column("text")).hash, return_counts=True)
            if len(h):
                found.append((h, c))
                size += len(h)
            if size > MOST_KINDS:
                found[:] = [merged()]
                size = len(found[0][0])
                if size > MOST_KINDS // 2:
                    yield _packed(found[0][0], bits, {"hash": found[0][0], "count": found[0][1]}, schema, {})
                    found.clear()
                    size = 0
        if found:
            h, c = merged()
            yield _packed(h, bits, {"hash": h, "count": c}, schema, {})

    def summed(batches):
        out = arrow_schema("part long, n long, total long, hash binary, count binary")
        for p, (h, c) in _grouped(batches):
            h, c = h.view(U), c.view(np.int64)
            order = np.argsort(h)
            h = h[order]
            at = runs(h)
            counts = np.add.reduceat(c[order], at[:-1])
            yield record_batch({"part": [p], "n": [len(counts)], "total": [int(counts.sum())], "hash": [h[at[:-1]].tobytes()], "count": [counts.tobytes()]}, out)

    rows = docs.select("text").mapInArrow(local, "part long, hash binary, count binary")
    return rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(summed, "part long, n long, total long, hash binary, count binary")


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all words over a count that at most ``most`` words reach."""

    def histogram(batches):
        for b in batches:
            for blob in b.column("count").to_pylist():
                x = np.bincount(np.minimum(np.frombuffer(blob, np.int64), 4096), minlength=4097)
                on = np.flatnonzero(x)
                yield record_batch({"value": on, "n": x[on]}, arrow_schema("value long, n long"))

    held = np.zeros(4097, np.int64)
    for r in counts.mapInArrow(histogram, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect():
        held[r.value] = r.n
    above = np.cumsum(held[::-1])[::-1]
    least = int(np.flatnonzero(above <= most)[0]) if (above <= most).any() else 4096

    def chosen(batches):
        out = arrow_schema("hash binary, count binary")
        for b in batches:
            for h, c in zip(b.column("hash").to_pylist(), b.column("count").to_pylist()):
                c = np.frombuffer(c, np.int64)
                h = np.frombuffer(h, U)
                on = c >= max(least, 1)
                yield record_batch({"hash": [h[on].tobytes()], "count": [c[on].tobytes()]}, out)

    rows = counts.mapInArrow(chosen, "hash binary, count binary").collect()
    h, c = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((0, U), (1, np.int64)))
    if len(h) > most:  # more words than that have the greatest count told apart
        own = np.lexsort((h, -c))[:most]
        h, c = h[own], c[own]
    return h, c


def train(docs: DataFrame, bits: int) -> tuple[Model, DataFrame]:
    """The model of all ``docs`` and the exact counts of their words."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs, bits), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    documents = docs.count()
    model = Model(*_commonest(counts, HELD_WORDS), sums.n + documents, sums.v + (documents > 0), documents)
    held = spark.sparkContext.broadcast(model)  # HELD_WORDS words and the empty tables
    schema = "tab int, chunk int, n double, at binary, zeros binary, ones binary"
    arrow = arrow_schema(schema)
    chunk_size = 1 << 14

    def learn(batches):
        """Online: each batch of documents is predicted by what the task has seen, refines the weights, and is then counted.

        Batches grow from one document, so that only a task's first, before which
        all log-odds are 0, refines nothing.
        """
        m = Model.__new__(Model)
        m.__dict__ = dict(held.value.__dict__)
        m.zeros, m.ones, m.weights = m.zeros.copy(), m.ones.copy(), m.weights.copy()
        m.spelling = Spelling()
        own = Vocabulary(m)
        events = 0
        size = 1

        for b in batches:
            at = 0
            while at < b.num_rows:
                numbers = own.number(b.column("text").slice(at, size), spell=False)
                at, size = at + size, min(2 * size, 256)
                odds = [_odds(m.zeros[k], m.ones[k]) for k in range(N_CONTEXTS)] if events else None
                rare, bits, all_slots = [], [], []
                for group in _together(numbers):
                    tokens, starts = _joined(group)
                    leaves = np.where(tokens < 0, m.end, own.leaf[tokens]) if len(own.leaf) else np.full(len(tokens), m.end)
                    own_events, slots, firsts = m.steps(leaves, tokens, starts)
                    if odds:
                        m.run(odds, m.weights, *own_events, slots, firsts, carry=True)
                    bits.append(own_events[1])
                    all_slots.append(slots)
                    r = leaves == m.escape
                    r[1:] &= tokens[1:] != tokens[:-1]
                    rare.append(tokens[r])
                bit = (np.concatenate(bits) > 0) * SLOTS
                for k in range(N_CONTEXTS):
                    both = np.bincount(np.concatenate([x[k] for x in all_slots]) + bit, minlength=2 * SLOTS)
                    m.zeros[k] += both[:SLOTS]
                    m.ones[k] += both[SLOTS:]
                events += len(bit)
                kinds, times = np.unique(np.concatenate(rare), return_counts=True)
                if len(kinds):
                    m.spelling.learn(own.words.spelled(own.first[kinds]), times)
        if not events:
            return
        tables = [*zip(m.zeros, m.ones), *zip(m.spelling.zeros, m.spelling.ones)]
        for t, (zeros, ones) in enumerate(tables):
            on = np.flatnonzero(zeros + ones > 0)
            for c in range(0, len(zeros), chunk_size):
                x = on[np.searchsorted(on, c) : np.searchsorted(on, c + chunk_size)]
                if len(x):
                    yield record_batch({"tab": [t], "chunk": [c // chunk_size], "n": [0.0], "at": [(x - c).astype(np.uint16).tobytes()], "zeros": [zeros[x].astype(np.uint32).tobytes()], "ones": [ones[x].astype(np.uint32).tobytes()]}, arrow)
        for t, w in ((-1, m.weights), (-2, m.spelling.weights)):
            yield record_batch({"tab": [t], "chunk": [0], "n": [float(events)], "at": [b""], "zeros": [(w * events).astype(np.float64).tobytes()], "ones": [b""]}, arrow)

    out_schema = "tab int, chunk int, n double, zeros binary, ones binary"

    def total(batches):
        """The sums of each table's chunks over all tasks."""
        out = arrow_schema(out_schema)
        key, n, zeros, ones = None, 0.0, None, None

        def done():
            return record_batch({"tab": [key[0]], "chunk": [key[1]], "n": [n], "zeros": [zeros.tobytes()], "ones": [ones.tobytes()]}, out)

        for b in batches:
            for tab, chunk, k, at, z, o in zip(*(c.to_pylist() for c in b.columns)):
                if (tab, chunk) != key:
                    if key is not None:
                        yield done()
                    key, n = (tab, chunk), 0.0
                    size = chunk_size if tab >= 0 else len(z) // 8
                    zeros, ones = np.zeros(size, np.float64), np.zeros(size, np.float64)
                n += k
                if tab >= 0:
                    x = np.frombuffer(at, np.uint16)
                    zeros[x] += np.frombuffer(z, np.uint32)
                    ones[x] += np.frombuffer(o, np.uint32)
                else:
                    zeros += np.frombuffer(z, np.float64)
        if key is not None:
            yield done()

    parts = n_partitions(spark)
    rows = docs.select("text").mapInArrow(learn, schema).repartition(parts, "tab", "chunk").sortWithinPartitions("tab", "chunk").mapInArrow(total, out_schema)
    for r in rows.toLocalIterator(prefetchPartitions=True):
        zeros, ones = np.frombuffer(r.zeros, np.float64), np.frombuffer(r.ones, np.float64)
        s = slice(r.chunk * chunk_size, (r.chunk + 1) * chunk_size)
        if r.tab == -1:
            model.weights = (zeros / r.n).reshape(model.weights.shape).astype(np.float32)
        elif r.tab == -2:
            model.spelling.weights = (zeros / r.n).reshape(model.spelling.weights.shape).astype(np.float32)
        else:
            m, k = (model, r.tab) if r.tab < N_CONTEXTS else (model.spelling, r.tab - N_CONTEXTS)
            m.zeros[k][s] = zeros
            m.ones[k][s] = ones
    return model, counts


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every whole text of ``docs`` by a model of those that aren't held out.

    Rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte. Tokens are the words (A-Z lower-cased) and one end. n_known
    counts the tokens that training has; base_score is the log10 probability by
    training counts plus one; score is the model's; bits_per_byte is the model's
    total over the text's UTF-8 bytes (0 for an empty text). Null text is empty
    and has its end alone. A row without doc_id is not held out; repeated rows
    count as often as they occur. If nothing can be trained, all counts are 0.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    n = n_partitions(spark)
    bits = max(4, (n - 1).bit_length() + 1)
    docs = id_text(docs).withColumn("held_out", held_out())
    model, counts = train(docs.where(~F.col("held_out")), bits)
    model.ready()
    model.zeros = model.ones = np.zeros((N_CONTEXTS, 1), np.float32)
    model.spelling.stretch = _odds(model.spelling.zeros, model.spelling.ones)
    model.spelling.zeros = model.spelling.ones = np.zeros((1, 1), np.float32)
    held = spark.sparkContext.broadcast(model)
    schema = "kind int, part long, task long, row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, logs double, score double, hash binary, row_of binary, times binary, spelled binary, fresh binary"
    arrow = arrow_schema(schema)
    ln10 = np.log(10)

    def score(batches):
        m = held.value
        task = TaskContext.get().partitionId()
        own = Vocabulary(m)
        row = 0
        asked: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            h, *others = (np.concatenate([x[k] for x in asked]) for k in range(5))
            asked.clear()
            order = np.argsort(h)
            cols = dict(zip(("hash", "row_of", "times", "spelled", "fresh"), (x[order] for x in (h, *others))))
            return _packed(h[order], bits, cols, arrow, {"kind": 1, "task": task})

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                numbers = own.number(part.column("text"))
                tokens = np.concatenate([np.zeros(0, np.int32), *numbers])
                n_words = np.array([len(x) for x in numbers])
                doc = np.repeat(np.arange(len(numbers)), n_words)
                here = own.count >= 0
                logs = np.bincount(doc, np.where(here, np.log10(np.maximum(own.count, 0) + 1.0), 0.0)[tokens], len(numbers))
                known = np.bincount(doc, (own.count > 0)[tokens], len(numbers)).astype(np.int64)
                far = np.flatnonzero(~here[tokens])
                if len(far):  # words whose counts aren't held, each once for a document
                    fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1]))[far]
                    pairs, at_pair = np.unique(doc[far] * len(own.hash) + tokens[far], return_inverse=True)
                    kind = pairs % len(own.hash)
                    times, times_fresh = np.bincount(at_pair), np.bincount(at_pair, fresh)
                    asked.append((own.hash[kind], (row + pairs // len(own.hash)).astype(np.int32), times.astype(np.int32), own.spelled[kind].astype(np.float32), times_fresh.astype(np.int32)))
                    size += len(pairs)
                n, none = len(numbers), [None] * len(numbers)
                rows = dict(zip(arrow.names, (
                    [0] * n, none, [task] * n, range(row, row + n), part.column("doc_id"), part.column("held_out"), n_words + 1, own.words.text_bytes,
                    known + (m.documents > 0), logs + np.log10(m.documents + 1.0), np.array(m.log_p(numbers, own)) / ln10, none, none, none, none, none,
                )))
                row += n
                yield record_batch(rows, arrow)
                if size >= 2_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    scored = materialize(docs.mapInArrow(score, schema), "scores")
    rare_schema = "place long, task binary, row binary, logs binary, known binary, score binary"

    def look_up(batches):
        """Counts of the words that aren't held: (task, row) with sums over its words."""
        out = arrow_schema(rare_schema)
        for _, (h, c), asked in _by_part(batches):
            tasks, rows, sums = [], [], []
            for task, ah, ar, times, spelled, fresh in asked:
                k = np.minimum(np.searchsorted(h, ah), max(len(h) - 1, 0))
                found = np.where(h[k] == ah, c[k], 0) if len(h) else np.zeros(len(ah), np.int64)
                order = np.argsort(ar, kind="stable")
                s = runs(ar[order])[:-1]
                tasks.append(np.full(len(s), task, np.int64))
                rows.append(ar[order][s].astype(np.int64))
                values = np.log10(found + 1.0) * times, (found > 0) * times.astype(float), held.value.with_count(spelled.astype(float), found) / ln10 * fresh
                sums.append(np.array([np.add.reduceat(v[order], s) for v in values]))
            if not tasks:
                continue
            task, row, (logs, known, score_) = np.concatenate(tasks), np.concatenate(rows), np.concatenate(sums, axis=1)
            place = mix((task * 1_000_003 + row // 4096).astype(U))
            order = np.argsort(place, kind="stable")
            cols = {"task": task, "row": row, "logs": logs, "known": known, "score": score_}
            cut = np.searchsorted(_part(place[order], bits), np.arange((1 << bits) + 1))
            on = [p for p in range(1 << bits) if cut[p] < cut[p + 1]]
            yield record_batch({"place": on} | {k: [v[order][cut[p] : cut[p + 1]].tobytes() for p in on] for k, v in cols.items()}, out)

    sums_schema = "task long, row long, more_logs double, more_known long, more_score double"

    def by_row(batches):
        out = arrow_schema(sums_schema)
        for _, (task, row, *sums) in _grouped(batches):
            task, row = task.view(np.int64), row.view(np.int64)
            order = np.lexsort((row, task))
            task, row = task[order], row[order]
            s = runs(task, row)[:-1]
            logs, known, score_ = (np.add.reduceat(x.view(np.float64)[order], s) for x in sums)
            yield record_batch({"task": task[s], "row": row[s], "more_logs": logs, "more_known": known.astype(np.int64), "more_score": score_}, out)

    asked = scored.where("kind = 1").select("part", F.lit(1).alias("kind"), "task", "hash", "row_of", "times", "spelled", "fresh")
    none = F.lit(None).cast("binary")
    tables = counts.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("task"), "hash", F.col("count").alias("row_of"), none.alias("times"), none.alias("spelled"), none.alias("fresh"))
    both = tables.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", "kind")
    found = both.mapInArrow(look_up, rare_schema).repartition(n, "place").sortWithinPartitions("place").mapInArrow(by_row, sums_schema)
    per_token = float(np.log10(model.n + model.v + 1))
    score_ = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return (
        scored.where("kind = 0")
        .join(found, ["task", "row"], "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(model.n)).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
            score_.alias("score"),
            F.when(F.col("n_bytes") > 0, -score_ * float(np.log2(10)) / F.col("n_bytes")).otherwise(0.0).alias("bits_per_byte"),
        )
    )


def _by_part(batches: Iterator[pa.RecordBatch]):
    """(part, (hashes, counts), what is asked) of rows sorted by part, the tables first."""
    nothing = np.zeros(0, U), np.zeros(0, np.int64)
    key, table, asked = None, nothing, []
    for b in batches:
        for part, kind, task, h, x, *others in zip(*(c.to_pylist() for c in b.columns)):
            if part != key:
                if key is not None:
                    yield key, table, asked
                key, table, asked = part, nothing, []
            if kind == 0:
                table = np.frombuffer(h, U), np.frombuffer(x, np.int64)
            else:
                asked.append((task, np.frombuffer(h, U), *(np.frombuffer(v, t) for v, t in zip((x, *others), (np.int32, np.int32, np.float32, np.int32)))))
    if key is not None:
        yield key, table, asked
