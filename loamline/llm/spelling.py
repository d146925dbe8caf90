"""Spelling variants: which words of a vocabulary differ by one letter, and which word of a chain of ever more frequent ones they stand for.

A vocabulary is searched with the search scheme of two halves in a bidirectional FM-index: one half of the word matches exactly, then the match is
extended across the other half, allowing one replaced, inserted or deleted code point.

1. Words that are one code point apart share either their first or their last code points, ``(length - 1) // 2`` of the longer one at least. Every word of
   the vocabulary is dealt to the two shards of its length with its first and with its last code points; as a query it goes to the shards
   of its own length, one more and one less. Shards are packed to about ``SHARD_WORDS`` words.
2. A shard's words, each after a delimiter, are indexed in both directions: suffix array by doubling, its transform in a wavelet matrix. Intervals of
   suffix ranks of a pattern and of its reverse are kept in step. All queries of a shard move together, letter by letter.
3. A shard returns for each query how many words it found and the most frequent of them; these are summed for each word.

A key (length and letters) of more than ``SHARD_WORDS`` words is split by a hash of its words, and its queries go to each part, so that no part outgrows a task;
for G words that makes G / SHARD_WORDS copies of G queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of one shard's index, about.
SHARD_WORDS = 50_000
#: Code points of queries that move together, padding included.
QUERY_CELLS = 1 << 20
#: Words shorter than this are not looked at.
LEAST_LENGTH = 5
RUN = r"[A-Za-zÀ-ÿ]+"


class Directed:
    """FM-index of words, each after a delimiter (symbol 0), as one circle. Delimiters sort by their places, so the words must be sorted."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, n_symbols: int):
        n, k = len(symbols) + len(lengths), len(lengths)
        heads = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(n, np.int64)
        letter = np.ones(n, bool)
        letter[heads] = False
        text[letter] = symbols
        rank = np.where(letter, k + text, 0)
        rank[heads] = np.arange(k)
        by = 1
        while True:
            pair = rank * (n + k + n_symbols + 1) + np.roll(rank, -by)
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            place = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = place
            if n < 2 or place[-1] == n - 1:
                break
            by *= 2
        last = text[order - 1]
        self.size = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # Wavelet matrix: at each level (a bit of the symbol, the leading one first) how many zeros stand before each place.
        self.zeros, row = [], last
        starts = np.zeros(n_symbols, np.int64)
        self.bits = max(1, int(n_symbols - 1).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)
            self.zeros.append(before)
            up = (np.arange(n_symbols) >> bit & 1).astype(bool)
            starts = np.where(up, before[-1] + starts - before[starts], before[starts])
            row = np.concatenate([row[~one], row[one]])
        self.starts = starts

    def step(self, lo: np.ndarray, n: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (first rank, size) extended by one symbol each, and how many of each interval extend by a smaller symbol."""
        hi, less = lo + n, np.zeros(len(lo), np.int64)
        for level, before in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            less += np.where(one, b - a, 0)
            lo, hi = np.where(one, before[-1] + lo - a, a), np.where(one, before[-1] + hi - b, b)
        return self.first[symbol] + lo - self.starts[symbol], hi - lo, less

    def spread(self, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of intervals: which interval, by which symbol, first rank, size, and how many extend by a smaller symbol."""
        of, symbol, hi, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), lo + n, np.zeros(len(lo), np.int64)
        for before in self.zeros:
            a, b = before[lo].astype(np.int64), before[hi].astype(np.int64)
            left, right = b > a, (hi - b) > (lo - a)
            of, symbol = np.concatenate([of[left], of[right]]), np.concatenate([2 * symbol[left], 2 * symbol[right] + 1])
            less = np.concatenate([less[left], (less + b - a)[right]])
            lo, hi = np.concatenate([a[left], (before[-1] + lo - a)[right]]), np.concatenate([b[left], (before[-1] + hi - b)[right]])
        return of, symbol, self.first[symbol] + lo - self.starts[symbol], hi - lo, less


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(w) for w in words], np.int64)


class Bidirectional:
    """Both directions over distinct words, with intervals kept in step: the rank of a pattern's interval among suffixes, and of its reverse among reversed ones."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        points, lengths = code_points(self.words)
        self.alphabet = np.unique(points)
        n_symbols = len(self.alphabet) + 1
        self.left = Directed(np.searchsorted(self.alphabet, points) + 1, lengths, n_symbols)
        points, lengths = code_points(sorted(w[::-1] for w in words))
        self.right = Directed(np.searchsorted(self.alphabet, points) + 1, lengths, n_symbols)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbols for each word, -1 for what the index does not have, delimiters (0) after the end; lengths."""
        points, lengths = code_points(words)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        own = np.where(self.alphabet[at] == points, at + 1, -1)
        table = np.zeros((len(words), int(lengths.max()) + 2), np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = own
        return table, lengths

    def near(self, words: list[str], last_half: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in ``self.words``) of the words one code point from each query: of its own length, one longer or one shorter, as ``change`` (0, 1, -1) asks, and
        with its first half, or, where ``last_half`` holds, its last half but not its first."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        order = np.argsort([len(w) for w in words], kind="stable")
        at = 0
        while at < len(order):
            width = len(words[order[at]]) + 2
            part = order[at : at + max(1, QUERY_CELLS // width)]
            cells = np.cumsum([len(words[k]) + 2 for k in part])
            part = part[: max(1, int(np.searchsorted(cells, QUERY_CELLS, side="right")))]
            own, half = [words[k] for k in part], last_half[part]
            for reverse in (False, True):
                some = np.flatnonzero(half == reverse)
                if len(some):
                    q, t = self._near([own[k] for k in some], change[part[some]], reverse)
                    found.append((part[some[q]], t))
            at += len(part)
        return np.concatenate([q for q, _ in found]), np.concatenate([t for _, t in found])

    def _near(self, words: list[str], change: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of one direction: reversed, the last half is matched from the end on and the first half extended to the left."""
        first, lengths = lengths_of_halves(words)
        table, _ = self.symbols([w[::-1] for w in words] if reverse else words)
        exact = lengths - first if reverse else first
        index = self.left if reverse else self.right
        # main: rank in the index that is extended; side: rank in the other one.
        def match(index, table, length):
            k = np.arange(len(words))
            main, side, n = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.full(len(k), index.size)
            main, n, side = index.step(main, n, np.zeros(len(k), np.int64))
            for j in range(int(length.max(initial=0))):
                go = k[(j < length[k]) & (n[k] > 0)]
                c = table[go, j]
                n[go[c < 0]] = 0
                go, c = go[c >= 0], c[c >= 0]
                main[go], n[go], less = index.step(main[go], n[go], c)
                side[go] += less
            return main, side, n

        main, side, n = match(index, table, exact)
        if reverse:  # words with the first half, which the other direction finds: a run of places in self.words
            _, from_, many = match(self.right, self.symbols(words)[0], first)
        q = np.flatnonzero(n > 0)
        j, main, side, n = exact[q], main[q], side[q], n[q]
        wrong = [np.zeros(0, np.int64) for _ in range(5)]  # query, next letter, main, side, size of matches with their error behind them
        done = []
        while len(q) or len(wrong[0]):
            # Matches with their error go on by the next letter, or by the delimiter.
            wq, wj, wm, ws, wn = wrong
            c = table[wq, wj]
            wq, wj, wm, ws, wn, c = (x[c >= 0] for x in (wq, wj, wm, ws, wn, c))
            wm, wn, less = index.step(wm, wn, c)
            ws = ws + less
            alive = wn > 0
            ended = alive & (wj == lengths[wq])
            done.append((wq[ended], (wm if reverse else ws)[ended]))
            alive &= ~ended
            new = [[x[alive] for x in (wq, wj + 1, wm, ws, wn)]]
            # A letter left out: of a run of equal letters the last.
            here, after, inside = table[q, j], table[q, np.minimum(j + 1, lengths[q])], j < lengths[q]
            out = np.flatnonzero((change[q] == -1) & inside & (here != after))
            new.append([x[out] for x in (q, j + 1, main, side, n)])
            # Another letter in place of this one, or before it (not the same one: that is an insertion further on).
            of, symbol, sm, sn, less = index.spread(main, n)
            other = (symbol > 0) & (symbol != np.where(inside, here, -2)[of])
            for kind, moved in ((0, 1), (1, 0)):
                use = np.flatnonzero(other & (change[q[of]] == kind) & (inside[of] if kind == 0 else True))
                new.append([q[of[use]], j[of[use]] + moved, sm[use], side[of[use]] + less[use], sn[use]])
            wrong = [np.concatenate(x) for x in zip(*new)]
            # The exact match goes on while letters are left.
            same = np.flatnonzero(inside[of] & (symbol == here[of]))
            q, j, main, side, n = q[of[same]], j[of[same]] + 1, sm[same], side[of[same]] + less[same], sn[same]
        q, t = np.concatenate([d[0] for d in done] or [np.zeros(0, np.int64)]), np.concatenate([d[1] for d in done] or [np.zeros(0, np.int64)])
        if reverse:
            new = ~((t >= from_[q]) & (t < from_[q] + many[q]))
            q, t = q[new], t[new]
        return q, t


def lengths_of_halves(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the first half of each word, and of the whole."""
    lengths = np.array([len(w) for w in words], np.int64)
    return lengths // 2, lengths


def searched(t: pa.Table) -> pa.Table:
    """One shard: its words and queries, to each query's number of near words and the most frequent of them (the smallest of equals)."""
    as_query = t["change"].is_valid().to_numpy()
    held, asked = t.filter(pa.array(~as_query)), t.filter(pa.array(as_query))
    known: dict[str, list] = {}
    for w, n, last in zip(held["word"].to_pylist(), held["n"].to_pylist(), held["last_half"].to_pylist()):
        known.setdefault(w, [n, False, False])[1 + last] = True
    words, empty = asked["word"].to_pylist(), pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    if not known or not words:
        return empty
    index = Bidirectional(list(known))
    last_half = asked["last_half"].to_numpy()
    q, found = index.near(words, last_half, asked["change"].to_numpy())
    # A word counts where it was dealt for the half that the query searches by; each word is dealt once for either.
    dealt = np.array([known[w] for w in index.words], np.int64)
    own = dealt[found, 1 + last_half[q].astype(np.int64)] > 0
    q, found = q[own], found[own]
    if not len(q):
        return empty
    n = dealt[found, 0]
    order = np.lexsort([found, -n, q])
    q, found, n = q[order], found[order], n[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    return pa.table({"word": [words[k] for k in q[head]], "n_near": np.diff(np.append(head, len(q))), "form_n": n[head], "form": [index.words[k] for k in found[head]]})


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, form_n, form (its most frequent near word, the smallest of equals) of the words that have near ones, among ``vocabulary`` (distinct ``word``, ``n``; written)."""
    length = F.length("word")

    def key(of_length: Column, last: bool) -> Column:
        shared = F.floor((of_length - 1) / 2).cast("int")
        part = F.substr(F.col("word"), length - shared + 1, shared) if last else F.substr(F.col("word"), F.lit(1), shared)
        return F.struct(of_length.cast("int").alias("length"), F.lit(last).alias("last_half"), part.alias("part"))

    held = vocabulary.select("word", "n", F.explode(F.array(key(length, False), key(length, True))).alias("k"), F.lit(None).cast("int").alias("change"))
    routes = [F.struct(key(length + c, last).alias("k"), F.lit(c).alias("change")) for c in (-1, 0, 1) for last in (False, True)]
    asked = vocabulary.select("word", "n", F.explode(F.array(*routes)).alias("r")).select("word", "n", "r.k", "r.change").where(F.col("k.length") >= LEAST_LENGTH)
    rows = held.unionByName(asked).select("word", "n", "k.*", "change")
    keys = ["length", "last_half", "part"]
    hot = held.select("k.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > shard_words).withColumn("parts", F.ceil(F.col("words") / shard_words).cast("int"))
    rows = rows.join(hot.drop("words"), keys, "left")
    parts = F.coalesce("parts", F.lit(1))
    to = F.when(F.col("change").isNull(), F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    n_shards = max(1, 2 * vocabulary.count() // shard_words)
    rows = rows.withColumn("part_", F.explode(to)).withColumn("shard", F.pmod(F.xxhash64(*keys, "part_"), F.lit(n_shards)))
    found = rows.select("shard", "word", "n", "last_half", "change").groupBy("shard").applyInArrow(searched, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("form_n"), "b.form")


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, slips: int = 97) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased, of at least ``LEAST_LENGTH`` code points and ``least`` occurrences.

    Where ``slips`` divides the crc32 of ``<key>:<run>``, the run counts without one of its code points (the crc32 modulo its length).
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key_"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("key_", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slips == 0, F.concat(F.substr("run", F.lit(1), cut), F.substr(F.col("run"), cut + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): forms followed to the last, by doubling; each round halves what is left of the longest chain."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(at.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        at = new.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, slips: int = 97, factor: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary``: ``form`` is its near word of most occurrences, the smallest of equals, if it has ``factor``
    times the word's own or more, else null; ``root`` the last of the chain of forms, the word itself if it has none.

    Null texts have no words; a null key counts as the empty text. Repeated rows count each time. Other columns are not read. An empty table gives an empty result.
    """
    words = written(vocabulary(docs, key, text, least, slips), "spelling-words")
    near = words.join(near_words(words, shard_words), "word", "left")
    enough = F.col("form_n") >= factor * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    near = written(near, "spelling-near")
    last = roots(near.where("form IS NOT NULL"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
