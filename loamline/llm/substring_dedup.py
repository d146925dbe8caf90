"""Substring dedup by recompression: removal of words that windows repeated from earlier places cover.

1. Texts are written as blocks of word hashes. In Spark rounds (``recompress``) each block deals its distinct new symbols - words, then runs
   and pairs - and the whole corpus names them, or finds that they stand in one place only. That closes all windows that hold them.
2. The windows that share all their symbols with other places are verified whole, by 128 bits: each block deals its distinct ones with
   the smallest key that has them, and learns which of them an earlier key has.
3. A document loses the words of its windows that a smaller key has, and of those that start earlier in itself.

Only distinct symbols and windows are exchanged, once from each block, so no copy, passage or key gathers in one task.

Rows are told apart by 128 bits of key and text; the key is only the order that decides which start is earlier. Rows that repeat a key are judged
apart from each other, each against documents of smaller keys and itself. Null keys sort before all others, and null texts are empty.
Windows never cross texts. Other columns pass through; columns named like the added ones are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Spans, bucketed, hashed_words, mixed, text_blocks, written
from .exchange import DEALT, Group, answered, beside, dealt, found_by_order, pack, pack_sorted, range_bits, unpack, unpack_sorted
from .recompress import ROUNDS, Parse

#: Text bytes of a block, about; numpy works on one at once.
BLOCK_BYTES = 4 << 20
#: Order of the windows, after those of the rounds.
WINDOWS = ROUNDS + 1
SEED = np.uint64(0x2545F4914F6CDD1D)
ADDED = ("n_words", "n_removed", "kept_text")
BLOCK = "block_ bigint, i_ array<bigint>, j_ array<bigint>, k_ array<bigint>, words_ binary, at_ binary, sizes_ binary, tokens_ bigint"
#: Smallest bigint as it is added to make signed numbers sort as unsigned ones.
SIGN = np.uint64(1 << 63)


def _blocks(window: int):
    """Texts of at least ``window`` words as blocks: row ids, keys, sorted distinct word hashes, words as places among them, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for part, texts in text_blocks(b.column(3), BLOCK_BYTES):
                tokens, starts = hashed_words(texts)
                sizes = np.diff(starts)
                whole = sizes >= window
                if not whole.any():
                    continue
                words, at = np.unique(tokens[np.repeat(whole, sizes)], return_inverse=True)
                ids = [b.column(i)[part.start : part.stop].filter(pa.array(whole)) for i in range(3)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in ids]
                packed = [pack_sorted(words), pack(at.astype(np.uint32)), pack(sizes[whole].astype(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, *[pa.array([x], pa.binary()) for x in packed], pa.array([len(at)])], names=["block_", "i_", "j_", "k_", "words_", "at_", "sizes_", "tokens_"])
                block += 1

    return run


def _parsed(row: dict, found: list[list[np.ndarray]], bits: int, window: int) -> tuple[Parse, np.ndarray, np.ndarray]:
    """A block's parse as far as its symbols are named, its words, and where its texts start."""
    starts = np.append(0, np.cumsum(unpack(row["sizes_"]).astype(np.int64)))
    parse = Parse(unpack_sorted(row["words_"]), unpack(row["at_"], np.uint32).astype(np.int64), starts, window)
    words = parse.name
    for k, (ranks, *_) in enumerate(found):
        codes, _ = parse.asked(k)
        # A name is a range of codes, a place in it, and the round; 0 stays 0.
        names = mixed(((codes >> np.uint64(64 - bits)) << np.uint64(32)) + ranks + (np.uint64(k) << np.uint64(60)))
        parse.named(np.where(ranks > 0, names, np.uint64(0)))
    return parse, words, starts


def _first_asked(bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, counts = _parsed(row, [], bits, window)[0].asked(0)
                yield dealt(row["block_"], bits, 0, codes, np.minimum(counts, 2).astype(np.uint64))

    return run


def _asked(bits: int, window: int, round_: int):
    def run(held: pa.Table, brought: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        codes, counts = _parsed(row, found_by_order(brought, round_), bits, window)[0].asked(round_)
        return pa.Table.from_batches([dealt(row["block_"], bits, round_, codes, np.minimum(counts, 2).astype(np.uint64))])

    return run


def _ranks(g: Group) -> pa.Table:
    """The place of each code among those of its group that stand twice or more; 0 for the others."""
    several = g.sums("x_") > 1
    return g.answer(np.repeat(np.where(several, np.cumsum(several), 0).astype(np.uint64), g.times))


class _Windows:
    """Windows still open, each told by 128 bits: place, text, and which of the block's sorted distinct ones it is."""

    def __init__(self, parse: Parse, words: np.ndarray, keys: np.ndarray):
        self.at = np.flatnonzero(parse.open)
        self.text = np.searchsorted(parse.first + 1, self.at, "right") - 1
        hashes = [Spans(x).of(self.at, self.at + parse.window) for x in (words, mixed(words ^ SEED))]
        order = np.lexsort(hashes[::-1])
        sorted_ = [h[order] for h in hashes]
        head = np.ones(len(order), bool)
        head[1:] = (sorted_[0][1:] != sorted_[0][:-1]) | (sorted_[1][1:] != sorted_[1][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(head) - 1
        self.codes, self.second = (h[head] for h in sorted_)
        self.key = keys[self.text]
        self.least = np.minimum.reduceat(self.key[order], np.flatnonzero(head)) if len(order) else self.key

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Places of windows that an earlier key has, here or elsewhere, or that start earlier in their own text."""
        again = earlier[self.which].astype(bool) | (self.key > self.least[self.which])
        order = np.lexsort((self.at, self.which, self.text))
        t, w = self.text[order], self.which[order]
        again[order[1:]] |= (t[1:] == t[:-1]) & (w[1:] == w[:-1])
        return self.at[again]


def _windows_of(row: dict, found: list[list[np.ndarray]], bits: int, window: int) -> tuple[_Windows, np.ndarray, np.ndarray]:
    parse, words, starts = _parsed(row, found, bits, window)
    return _Windows(parse, words, np.array(row["k_"], np.int64).view(np.uint64) ^ SIGN), words, starts


def _windows(bits: int, window: int):
    def run(held: pa.Table, brought: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        w, _, _ = _windows_of(row, found_by_order(brought, WINDOWS), bits, window)
        return pa.Table.from_batches([dealt(row["block_"], bits, WINDOWS, w.codes, w.second, w.least)])

    return run


def _earlier(g: Group) -> pa.Table:
    """Whether another block has a smaller key for the same window."""
    second, key = g.values("x_"), g.values("y_")
    order = np.lexsort((second, np.repeat(np.arange(len(g.head)), g.times)))
    s = second[order]
    head = np.zeros(len(s), bool)
    head[g.head] = True
    head[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(head)
    least = np.repeat(np.minimum.reduceat(key[order], at), np.diff(np.append(at, len(s))))
    out = np.empty(len(s), np.uint64)
    out[order] = least < key[order]
    return g.answer(out)


def _covered(bits: int, window: int):
    """For each text that loses words its row id and the ranges of words, start and end by turns."""

    def run(held: pa.Table, brought: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        found = found_by_order(brought, WINDOWS + 1)
        w, words, starts = _windows_of(row, found[:WINDOWS], bits, window)
        depth = np.zeros(len(words) + 1, np.int64)
        at = w.repeated(found[WINDOWS][0])
        depth[at] += 1
        depth[at + window] -= 1  # windows start at different words, so no index repeats
        gone = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
        a, b = np.flatnonzero(~gone[:-1] & gone[1:]), np.flatnonzero(gone[:-1] & ~gone[1:])
        # Ranges end at the ends of texts too.
        inner = starts[1:-1]
        inner = inner[gone[inner] & gone[inner + 1]]
        cut, ends = np.sort(np.append(a, inner)), np.sort(np.append(b, inner))
        text = np.searchsorted(starts, cut, "right") - 1
        some, first = np.unique(text, return_index=True)
        both = np.stack([cut - starts[text], ends - starts[text]], 1).ravel()
        ids = [pa.array([row[c][t] for t in some], pa.int64()) for c in ("i_", "j_")]
        return pa.table({"i_": ids[0], "j_": ids[1], "ranges_": pa.ListArray.from_arrays(pa.array(np.append(2 * first, len(both)), pa.int32()), pa.array(both))})

    return run


def _without(text_at: int, n_columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ranges = b.column(text_at).cast(pa.binary()), b.column(n_columns)
            n_words, n_removed, kept = [], [], []
            for k in range(b.num_rows):
                words, own = (texts[k].as_py() or b"").split(), ranges[k].as_py()
                n_words.append(len(words))
                if own:
                    ends = [0, *own, n_words[-1]]
                    words = [w for a, z in zip(ends[::2], ends[1::2], strict=True) for w in words[a:z]]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_columns], *extra], names=[*b.schema.names[:n_columns], *ADDED])

    return run


def repeated_ranges(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """i_, j_ (of ``_row_id``) and ranges_ for each distinct row that loses words."""
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    keyed = docs.select(*_row_id(key, text), k.alias("k_"), F.col(text).alias("text_"))
    held = bucketed(keyed.mapInArrow(_blocks(window), BLOCK), "repeat-blocks", "block_")
    bits = range_bits(docs.sparkSession, held.agg(F.sum("tokens_")).first()[0] or 0)
    names = answered(held.mapInArrow(_first_asked(bits, window), DEALT), _ranks, "repeat-names")
    for k in range(1, ROUNDS + 1):
        new = answered(beside(held, names).applyInArrow(_asked(bits, window, k), DEALT), _ranks, "repeat-names")
        names = names.unionByName(new)
    shared = answered(beside(held, names).applyInArrow(_windows(bits, window), DEALT), _earlier, "repeat-windows")
    ranges = beside(held, names.unionByName(shared)).applyInArrow(_covered(bits, window), "i_ bigint, j_ bigint, ranges_ array<bigint>")
    return written(ranges.dropDuplicates(["i_", "j_"]), "repeat-ranges")  # rows of one id have one text


def _row_id(key: str, text: str) -> list:
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    return [F.xxhash64(k, F.col(text)).alias("i_"), F.xxhash64(F.lit(1), k, F.col(text)).alias("j_")]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """``docs``, all columns, with n_words, n_removed and kept_text: the words not removed, joined by one space."""
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    ranges = repeated_ranges(docs, key, text, window)
    names = docs.columns
    whole = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(names)], *_row_id(key, text))
    whole = whole.join(ranges, ["i_", "j_"], "left").select(*[f"c{i}_" for i in range(len(names))], "ranges_")
    fields = [StructField(f"c{i}_", f.dataType) for i, f in enumerate(docs.schema.fields)]
    added = [StructField(n, t) for n, t in zip(ADDED, (LongType(), LongType(), StringType()), strict=True)]
    done = whole.mapInArrow(_without(names.index(text), len(names)), StructType([*fields, *added]))
    return done.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)], *ADDED)
