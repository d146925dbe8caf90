"""LM scoring: n-grams smoothed by absolute discounts, as a weighted backoff automaton that each text is walked through once.

Counts cover the whole training side. Every word is a state, and every pair and triple that occurs ``LEAST`` times or more is an arc, whatever
the size of the corpus, so the model grows with it. No place holds the model: its counts and weights are tables, and each
block of texts (about ``BLOCK_BYTES``) is brought those of its own distinct n-grams.

1. Blocks are written: the distinct word hashes of each, and its texts as places among them.
2. Each block tells its distinct words, pairs and triples, as sorted 64-bit hashes with the block's own training counts, dealt by leading bits.
   Counts are summed, and each block gets back the sums in the order of its hashes. A hot n-gram comes once from each block.
3. One block of those that hold an n-gram adds it to its context's sums, which are whole numbers; these are dealt and brought back likewise, and give
   the backoff weights.
4. Each block builds its own part of the automaton (``BlockAutomaton``) and walks its texts through it from left to right, many lanes side by side.

A state is the longest kept suffix of what has been read. A walk carries its state: it takes the arc for the next word if the state has it; otherwise it adds the
state's backoff weight, follows the failure arc to the next shorter suffix, and at the root takes the word's own probability,
``(c + 1) / (N + V + 1)``. Words are told apart by 64-bit hashes; words are lower-cased (A-Z) runs of bytes outside white space, then one end.

Null texts are empty: one end token. Repeated rows count and are scored each. Null keys count as the empty text in the split. Without
training rows all probabilities are 1. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, hashed_words, mixed, text_blocks
from .exchange import DEALT, Group, answered, beside, dealt, found_by_order, pack, pack_sorted, range_bits, unpack, unpack_sorted

#: Pairs and triples that occur less often in training are left to backoff.
LEAST = 2
DISCOUNT = 0.75
#: Stand for the end and the start of a text among the word hashes.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
BLOCK_BYTES = 4 << 20
WORD, PAIR, TRIPLE, WORD_BACKOFF, PAIR_BACKOFF = range(5)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text and its end, and where each text starts."""
    words, starts = hashed_words(texts, lower=True)
    n = len(texts)
    out = np.full(len(words) + n, END)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(starts))] = words
    return out, starts + np.arange(n + 1)


class Automaton:
    """The whole model in memory, for small corpora: what ``score`` must agree with.

    States: one for each word (by its number), one for the start of a text, one for each kept pair. ``hashes`` are the words, sorted,
    ``counts`` theirs; ``pairs`` and ``triples`` map number tuples to counts.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, starts: int, pairs: dict | None = None, triples: dict | None = None):
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct
        self.start, self.root, self.base = len(hashes), -1, total + distinct + 1
        self.starts, self.pairs, self.triples = starts, pairs or {}, triples or {}
        p_word = ((counts + 1) / self.base).tolist()
        seen = [*counts.tolist(), starts]
        self.own = [math.log10(p) for p in p_word]
        self.state_of = {pair: self.start + 1 + i for i, pair in enumerate(sorted(self.pairs))}
        self.width = self.start + 1
        self.arcs: dict[int, tuple[float, int]] = {}
        p_pair, spent, lower = {}, {}, {}
        for (h, w), c in self.pairs.items():
            p_pair[h, w] = p = (c - DISCOUNT) / seen[h]
            spent[h], lower[h] = spent.get(h, 0.0) + p, lower.get(h, 0.0) + p_word[w]
            self.arcs[h * self.width + w] = (math.log10(p), self.state_of[h, w])
        self.backoff = [0.0] * (self.start + 1 + len(self.pairs))
        self.failure = [self.root] * (self.start + 1) + [0] * len(self.pairs)
        rest = lambda s, low: max(1e-12, 1 - s) / max(1e-12, 1 - low)
        for h in spent:
            self.backoff[h] = math.log10(rest(spent[h], lower[h]))
        spent3, lower3 = {}, {}
        for (a, b, w), c in self.triples.items():
            state = self.state_of[a, b]
            p = (c - DISCOUNT) / self.pairs[a, b]
            low = p_pair.get((b, w)) or 10 ** self.backoff[b] * p_word[w]
            spent3[state], lower3[state] = spent3.get(state, 0.0) + p, lower3.get(state, 0.0) + low
            self.arcs[state * self.width + w] = (math.log10(p), self.state_of.get((b, w), w))
        for pair, state in self.state_of.items():
            self.failure[state] = pair[1]
            if state in spent3:
                self.backoff[state] = math.log10(rest(spent3[state], lower3[state]))

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Number of each token, -1 for words that are not frequent."""
        if not len(self.hashes):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, at, -1)

    def walk(self, numbers: list[int]) -> float:
        """Log10 probability of a text's tokens, without the own probabilities of words that are not frequent."""
        arcs, backoff, failure, own, width, root = self.arcs, self.backoff, self.failure, self.own, self.width, self.root
        state, total = self.start, 0.0
        for w in numbers:
            if w < 0:
                while state != root:
                    total += backoff[state]
                    state = failure[state]
                continue
            while state != root:
                arc = arcs.get(state * width + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += backoff[state]
                state = failure[state]
            else:
                total += own[w]
                state = w
        return total


def _blocks(kind: pa.DataType):
    """Rows of (key, text, learn, rate) as blocks: sorted distinct words, the texts as places among them, tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for part, texts in text_blocks(b.column(1), BLOCK_BYTES):
                tokens, starts = token_hashes(texts)
                words, at = np.unique(tokens, return_inverse=True)
                learn, rate = (b.column(i)[part.start : part.stop].to_numpy(zero_copy_only=False).astype(np.uint8) for i in (2, 3))
                keys = b.column(0)[part.start : part.stop].filter(pa.array(rate.astype(bool)))
                columns = [pack_sorted(words), pack(at.astype(np.uint32)), pack(np.diff(starts).astype(np.uint64)), learn.tobytes(), rate.tobytes()]
                lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(kind))
                yield pa.RecordBatch.from_arrays([pa.array([block]), lists, *[pa.array([x], pa.binary()) for x in columns], pa.array([len(tokens)])], names=["block_", "keys_", "words_", "at_", "sizes_", "learn_", "rate_", "tokens_"])
                block += 1

    return run


class _Grams:
    """N-grams of a block: for each token the place of its word, pair and triple among the block's sorted distinct ones (-1: none)."""

    def __init__(self, row: dict, *orders: int):
        self.words, self.at = unpack_sorted(row["words_"]), unpack(row["at_"], np.uint32).astype(np.int64)
        self.sizes = unpack(row["sizes_"], np.uint64).astype(np.int64)
        self.learn, self.rate = (np.frombuffer(row[c], np.uint8).astype(bool) for c in ("learn_", "rate_"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Place of the word before each token; the start of a text comes after all words.
        self.before = np.concatenate([[0], self.at[:-1]])
        self.before[self.starts] = len(self.words)
        w = self.words[self.at]
        code = mixed(mixed(np.append(self.words, START)[self.before] + np.uint64(2)) ^ w)
        if PAIR in orders:
            self.pairs, self.pair_first, self.pair = np.unique(code, return_index=True, return_inverse=True)
        if TRIPLE not in orders:
            return
        self.second = np.ones(len(w), bool)
        self.second[self.starts] = False
        later = np.flatnonzero(self.second)
        self.triples, first, inverse = np.unique(mixed(mixed(code[later - 1] + np.uint64(3)) ^ w[later]), return_index=True, return_inverse=True)
        self.triple_first, self.triple = later[first], np.full(len(w), -1)
        self.triple[later] = inverse

    def weights(self, brought: list[list[np.ndarray]], base: int) -> None:
        """Counts and conditional probabilities, where kept, of what the block holds."""
        self.n1, self.n2, self.n3 = ((brought[k][0] >> np.uint64(1)).astype(np.int64) for k in (WORD, PAIR, TRIPLE))
        self.own2, self.own3 = ((brought[k][0] & np.uint64(1)).astype(bool) for k in (PAIR, TRIPLE))
        self.seen = seen = np.append(self.n1, self.n1[np.searchsorted(self.words, END)])  # each text has one start and one end
        self.p1 = (self.n1 + 1) / base
        self.kept2, self.kept3 = self.n2 >= LEAST, self.n3 >= LEAST
        self.context2, self.context3 = self.before[self.pair_first], self.pair[self.triple_first - 1]
        self.p2 = np.where(self.kept2, (self.n2 - DISCOUNT) / np.maximum(seen[self.context2], 1), 1.0)
        self.p3 = np.where(self.kept3, (self.n3 - DISCOUNT) / np.maximum(self.n2[self.context3], 1), 1.0)


def _counts(bits: int, *orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g = _Grams(row, *orders)
                learnt = np.repeat(g.learn, g.sizes)
                for order in orders:
                    codes, at = (g.words, g.at) if order == WORD else (g.pairs, g.pair) if order == PAIR else (g.triples, g.triple)
                    n = np.bincount(at[learnt & (at >= 0)], minlength=len(codes)).astype(np.uint64)
                    yield dealt(row["block_"], bits, order, codes, n)

    return run


def _summed_counts(g: Group) -> pa.Table:
    """Twice the count of each code (of pairs and triples, if kept, else 0), one more in the first block that has it."""
    sums, word = g.sums("x_"), g.order_ == WORD
    doubled = np.repeat(np.where(word | (sums >= LEAST), sums * np.uint64(2), np.uint64(0)), g.times)
    doubled[g.head] += np.uint64(1)
    return g.answer(doubled, total=int(sums.sum()) if word else 0, distinct=int(np.count_nonzero(sums)) if word else 0)


def _summed_contexts(g: Group) -> pa.Table:
    return g.answer(*[np.repeat(g.sums(c), g.times) for c in ("x_", "y_", "z_")])


def _log_backoff(spent: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(1e-12, 1 - spent) / np.maximum(1e-12, 1 - lower))


def _contexts(bits: int, base: int):
    """What the n-grams that a block owns take from their contexts, and what these would give them by backoff."""

    def run(held: pa.Table, brought: pa.Table) -> pa.Table:
        row, found = held.to_pylist()[0], found_by_order(brought, TRIPLE + 1)
        g = _Grams(row, PAIR, TRIPLE)
        g.weights(found, base)
        # Whole numbers all along: how many n-grams a context has, their counts, and the counts of what it would back off to.
        sums = lambda context, n, *values: [np.bincount(context, v, n).astype(np.uint64) for v in (None, *values)]
        mine = np.flatnonzero(g.kept2 & g.own2)
        names = np.append(g.words, START)
        order = np.argsort(names)
        of_words = sums(g.context2[mine], len(names), g.n2[mine], g.n1[g.at[g.pair_first[mine]]] + 1)
        words = dealt(row["block_"], bits, WORD_BACKOFF, names[order], *[x[order] for x in of_words])
        mine = np.flatnonzero(g.kept3 & g.own3)
        of_pairs = sums(g.context3[mine], len(g.pairs), g.n3[mine], g.n2[g.pair[g.triple_first[mine]]])
        return pa.Table.from_batches([words, dealt(row["block_"], bits, PAIR_BACKOFF, g.pairs[g.kept2], *[x[g.kept2] for x in of_pairs])])

    return run


class BlockAutomaton:
    """The part of the automaton that a block's texts can reach, from what the block was brought.

    States: the block's distinct words by number, the start of a text after them, then its kept pairs. ``keys`` (state times words plus word) are the arcs, sorted; an arc has
    a weight and leads to a state. A state without an arc for a word has a backoff weight and a failure arc: a pair's to its last word, a word's to the root.
    """

    ROOT = -1
    #: Tokens of a text that one lane walks. States hold two words at most, so a lane that reads the two tokens before its own from the root on has the state of a walk
    #: through all of the text.
    LANE, WARM = 256, 2

    def __init__(self, g: _Grams, brought: list[list[np.ndarray]], base: int):
        g.weights(brought, base)
        self.n_words = self.start = len(g.words)
        names = np.append(g.words, START)
        order = np.argsort(names)
        arcs, spent, lower = (x.astype(np.float64) for x in brought[WORD_BACKOFF])
        backoff = np.empty(len(names))
        backoff[order] = _log_backoff((spent - DISCOUNT * arcs) / np.maximum(g.seen[order], 1), lower / base)
        arcs, spent, lower = (x.astype(np.float64) for x in brought[PAIR_BACKOFF])
        pairs, triples = np.flatnonzero(g.kept2), np.flatnonzero(g.kept3)
        last = g.at[g.pair_first]
        of_pair = np.full(len(g.pairs), self.ROOT)
        of_pair[pairs] = self.start + 1 + np.arange(len(pairs))
        self.own = np.log10(g.p1)
        self.backoff = np.append(backoff, _log_backoff((spent - DISCOUNT * arcs) / g.n2[pairs], (lower - DISCOUNT * arcs) / np.maximum(g.seen[last[pairs]], 1)))
        self.failure = np.append(np.full(self.start + 1, self.ROOT), last[pairs])
        word, longer = g.at[g.triple_first[triples]], of_pair[g.pair[g.triple_first[triples]]]
        keys = np.append(g.context2[pairs] * self.n_words + last[pairs], of_pair[g.context3[triples]] * self.n_words + word)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.append(np.log10(g.p2)[pairs], np.log10(g.p3)[triples])[order]
        self.to = np.append(of_pair[pairs], np.where(longer >= 0, longer, word))[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reading a word each adds to the scores of some lanes, and their states after it."""
        gain, after, left = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(left):
            root = after[left] == self.ROOT
            done = left[root]
            gain[done] += self.own[word[done]]
            after[done] = word[done]
            left = left[~root]
            key = after[left] * self.n_words + word[left]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(left), bool)
            gain[left[hit]] += self.weight[at[hit]]
            after[left[hit]] = self.to[at[hit]]
            left = left[~hit]
            gain[left] += self.backoff[after[left]]
            after[left] = self.failure[after[left]]
        return gain, after

    def walk(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each token of texts (``words``, of which each text has a run) and the state after it. All lanes of all texts go on side by side."""
        lanes = -(-sizes // self.LANE)
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = np.repeat(starts, lanes) + nth * self.LANE
        end = np.minimum(own + self.LANE, np.repeat(starts + sizes, lanes))
        at, state = own - self.WARM * (nth > 0), np.where(nth > 0, self.ROOT, self.start)
        gains, states = np.zeros(len(words)), np.zeros(len(words), np.int64)
        while len(at):
            gain, state = self.step(state, words[at])
            scored = at >= own
            gains[at[scored]], states[at[scored]] = gain[scored], state[scored]
            on = at + 1 < end
            at, own, end, state = at[on] + 1, own[on], end[on], state[on]
        return gains, states


def _walked(base: int, kind: pa.DataType):
    def run(held: pa.Table, brought: pa.Table) -> pa.Table:
        row, found = held.to_pylist()[0], found_by_order(brought, PAIR_BACKOFF + 1)
        g = _Grams(row, PAIR, TRIPLE)
        automaton = BlockAutomaton(g, found, base)
        gains, _ = automaton.walk(g.at, g.starts, g.sizes)
        known = (g.n1 > 0)[g.at].astype(np.int64)
        rated = lambda x: pa.array(np.add.reduceat(x, g.starts)[g.rate])
        return pa.table({"key_": held["keys_"].chunk(0).flatten().cast(kind), "n_tokens": pa.array(g.sizes[g.rate]), "n_known": rated(known), "base_score": rated(automaton.own[g.at]), "score": rated(gains)})

    return run


def score_rows(rows: DataFrame, learn: Column, rate: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, n_known, train_tokens, base_score, score for each of ``rows`` where ``rate`` holds, with a model of those where ``learn`` does."""
    spark, field = rows.sparkSession, rows.schema[key]
    kind, arrow = field.dataType.simpleString(), rows.select(key).limit(0).toArrow().schema.field(0).type
    asked = rows.select(F.col(key), F.col(text), F.coalesce(learn, F.lit(False)), F.coalesce(rate, F.lit(False)))
    held = bucketed(asked.mapInArrow(_blocks(arrow), f"block_ bigint, keys_ array<{kind}>, words_ binary, at_ binary, sizes_ binary, learn_ binary, rate_ binary, tokens_ bigint"), "lm-blocks", "block_")
    tokens = held.agg(F.sum("tokens_")).first()[0] or 0
    bits = range_bits(spark, tokens)
    # One job after the other, so that the shuffle of one is gone before the next.
    counts, triples = (answered(held.mapInArrow(_counts(bits, *orders), DEALT), _summed_counts, "lm-counts") for orders in ((WORD, PAIR), (TRIPLE,)))
    counts = counts.unionByName(triples)
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("total_"), F.sum("distinct_")).first())
    base = total + distinct + 1
    contexts = answered(beside(held, counts).applyInArrow(_contexts(bits, base), DEALT), _summed_contexts, "lm-contexts")
    walked = beside(held, counts.unionByName(contexts)).applyInArrow(_walked(base, arrow), f"key_ {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return walked.select(F.col("key_").alias(key), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score_rows`` of ``docs`` with a model of the texts of ``train``."""
    both = docs.select(key, text, F.lit(True).alias("rate_")).unionAll(train.select(key, text, F.lit(False).alias("rate_")))
    return score_rows(both, ~F.col("rate_"), F.col("rate_"), key, text)
