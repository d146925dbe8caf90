"""Conversation prefix trie: which conversations begin alike, and what tokens their common turns would save.

1. Turns get places in their conversations by a range sort (so a conversation of any length is in many tasks), and each prefix a 128-bit name:
   the exclusive or of hashes of (turn, place), summed by blocks of a conversation.
2. Conversations that are equal from end to end are one sequence with a count. A prefix that only one sequence has needs no trie: its figures follow from the
   sequence's running sums (the tail).
3. Prefixes that several sequences share are cut into shards: below the first prefix that has at most ``SHARD_ROWS`` turns under it. Shards are packed
   into tasks of about that size. A task numbers its turns densely, packs the transitions of its tries into a double array (a node's child by turn t is the slot
   BASE[node] + t if CHECK says so), walks all sequences through it side by side, and sums its nodes from the leaves up.
4. Nodes above the shards are shared by them. Their counts are summed by name; sums of subtrees flow up along the prefixes of the smallest conversation of each
   node and each shard, so each node counts once.
5. Conversations that end at a node are hashed in order of their ids: runs of ids are joined in many tasks and streamed through the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of one shard's tries, at most, and of one task, about.
SHARD_ROWS = 100_000
#: Turns of a conversation that one window sums.
BLOCK_TURNS = 1024
#: Ids joined in one row before they are hashed.
RUN_IDS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def placed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 0, m: MD5 of role and text, w: words) and conversations (conv_id, length). Turns of equal order go by MD5."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")).alias("m"), F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("w"))
    order = ["conv_id", "turn", "m"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "trie-turns").withColumn("part", F.shiftright("id", 33))
    pieces = rows.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select("conv_id", "part", (F.col("first") - before).alias("start"))
    return rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("id") - F.col("start")).alias("pos"), "m", "w"), pieces.groupBy("conv_id").agg(F.sum("n").alias("length"))


def rebuilt(turns: DataFrame, lengths: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d from 1, m, w) and ids of conversations of which the first h turns (crc32 of the id, modulo ``most``) are those of the conversation at ``every``."""
    c = F.col("conv_id")
    own = lengths.select("conv_id", "length", (c - c % every).alias("from_id"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    given = own.where(c % every == 0).select(c.alias("from_id"), F.col("length").alias("given"))
    own = own.join(given, "from_id", "left").withColumn("lead", F.least(F.coalesce("given", F.lit(0)), "h"))
    rest = turns.join(own.select("conv_id", "h", "lead"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead") + 1).alias("d"), "m", "w")
    heads = turns.where((c % every == 0) & (F.col("pos") < most)).select(c.alias("from_id"), "pos", "m", "w")
    lead = own.join(heads, "from_id").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("d"), "m", "w")
    return rest.unionByName(lead), lengths.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the names of the prefix that ends (p1, p2) and that ends before (q1, q2), and the words so far (cw)."""
    named = turns.withColumns({"x1": F.xxhash64(F.lit(1), "m", "d"), "x2": F.xxhash64(F.lit(2), "m", "d"), "block": F.floor((F.col("d") - 1) / BLOCK_TURNS)})
    sums = lambda over, p: [f.over(over).alias(a) for f, a in ((F.bit_xor("x1"), f"{p}1"), (F.bit_xor("x2"), f"{p}2"), (F.sum("w"), f"{p}w"))]
    upto = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    blocks = named.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("w").alias("w"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *sums(earlier, "b")).where("block > 0")
    rows = named.select("*", *sums(upto, "l")).join(carried, ["conv_id", "block"], "left")
    p = [F.col(f"l{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    return rows.select("conv_id", "d", "m", "w", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("x1")).alias("q1"), p[1].bitwiseXOR(F.col("x2")).alias("q2"), (F.col("lw") + F.coalesce("bw", F.lit(0))).alias("cw"))


class DoubleArray:
    """Tries over dense symbols: the child of slot s by symbol c is slot ``base[s] + c`` if its ``check`` is s. Slot 0 is the root.

    Built from the symbols of sequences level by level: ``levels`` has for each level the sequences that go on and their symbols.
    """

    #: Free slots that a node with several children tries, of so many from the first free one on, before it goes to the end.
    TRIES, WINDOW = 32, 4096

    def __init__(self, n_sequences: int, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1)
        self.check[0], self.end, self.low = -2, 1, 1
        at = np.zeros(n_sequences, np.int64)
        for own, symbols in levels:
            order = np.lexsort([symbols, at[own]])
            parents, children = at[own][order], symbols[order]
            new = np.append(True, (parents[1:] != parents[:-1]) | (children[1:] != children[:-1]))
            parents, children = parents[new], children[new]
            heads = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
            sizes = np.diff(np.append(heads, len(parents)))
            for h, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                self._place(int(parents[h]), children[h : h + n])
            self._place_alone(parents[heads[sizes == 1]], children[heads[sizes == 1]])
            at[own] = self.base[at[own]] + symbols

    def _free(self, some: int) -> np.ndarray:
        """At least ``some`` free slots, in order."""
        while True:
            free = self.low + np.flatnonzero(self.check[self.low :] == -1)
            if len(free) >= some:
                self.low = int(free[0])
                return free
            self._grow(len(self.check) + some)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1))

    def _place(self, parent: int, symbols: np.ndarray) -> None:
        some = self.low + np.flatnonzero(self.check[self.low : self.low + self.WINDOW] == -1)[: self.TRIES]
        if not len(some):
            self.low = int(self._free(1)[0])
        for slot in [*some.tolist(), self.end]:
            slots = slot - symbols[0] + symbols
            self._grow(int(slots[-1]) + 1)
            if (self.check[slots] == -1).all():
                break
        self.base[parent], self.check[slots], self.end = slots[0] - symbols[0], parent, max(self.end, int(slots[-1]) + 1)

    def _place_alone(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        if len(parents):
            slots = self._free(len(parents))[: len(parents)]
            self.base[parents], self.check[slots], self.end = slots - symbols, parents, max(self.end, int(slots[-1]) + 1)

    def walk(self, n_sequences: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The slots that sequences reach at each level; -1 from where they leave the trie."""
        at, found = np.zeros(n_sequences, np.int64), []
        for own, symbols in levels:
            to = np.where(at[own] >= 0, self.base[at[own]] + symbols, -1)
            held = (to >= 0) & (to < len(self.check))
            held[held] = self.check[to[held]] == at[own][held]
            at[own] = np.where(held, to, -1)
            found.append(at[own])
        return found


NODES = "p1 bigint, p2 bigint, q1 bigint, q2 bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def summed(t: pa.Table) -> pa.Table:
    """The nodes of the tries of one task. ``parent_conv_id`` is null for the tops of shards."""
    t = t.sort_by([("s1", "ascending"), ("s2", "ascending"), ("conv_id", "ascending"), ("d", "ascending")])
    col = {c: t[c].to_numpy() for c in ("s1", "s2", "conv_id", "d", "w", "p1", "p2", "q1", "q2", "n", "tail", "tail_saved", "more")}
    new_shard = np.append(True, (col["s1"][1:] != col["s1"][:-1]) | (col["s2"][1:] != col["s2"][:-1]))
    new = new_shard.copy()
    new[1:] |= col["conv_id"][1:] != col["conv_id"][:-1]
    sequence, shard, start = np.cumsum(new) - 1, np.cumsum(new_shard) - 1, np.flatnonzero(new)
    level = np.arange(len(new)) - start[sequence]
    order = np.argsort(level, kind="stable")
    # Turns are numbered in the order of levels, so that those of siblings are close. The top of a shard is its own symbol.
    named = pa.chunked_array([t["m"].combine_chunks().take(pa.array(order))]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    symbol = np.empty(len(order), np.int64)
    symbol[order] = named
    symbol = np.where(level == 0, symbol.max() + 1 + shard, symbol)
    bounds = np.searchsorted(level[order], np.arange(level.max() + 2))
    rows = [order[a:z] for a, z in zip(bounds[:-1], bounds[1:])]
    levels, n_sequences = [(sequence[r], symbol[r]) for r in rows], len(start)
    trie = DoubleArray(n_sequences, levels)
    slots = trie.walk(n_sequences, levels)
    size = len(trie.check)
    n_convs, n_leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    least, row_of, children = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    nodes = []
    for r, s in zip(rows, slots):
        np.add.at(n_convs, s, col["n"][r])
        np.minimum.at(least, s, col["conv_id"][r])
        row_of[s] = r
        nodes.append(np.unique(s))
        if len(nodes) > 1:
            np.add.at(children, trie.check[nodes[-1]], 1)
    for own in reversed(nodes):
        r = row_of[own]
        tail = col["tail"][r]
        children[own] = np.where(tail, col["more"][r], children[own])
        n_leaves[own] += tail | (children[own] == 0)
        saved[own] += np.where(tail, col["tail_saved"][r], (n_convs[own] - 1) * col["w"][r])
        up = trie.check[own]
        np.add.at(n_leaves, up, n_leaves[own])
        np.add.at(saved, up, saved[own])
    own = np.concatenate(nodes)
    r, up = row_of[own], trie.check[own]
    parents = pa.array(least[up], mask=up == 0)
    return pa.table({**{c: col[c][r] for c in ("p1", "p2", "q1", "q2")}, "conv_id": least[own], "depth": col["d"][r], "parent_conv_id": parents, "n_convs": n_convs[own], "n_children": children[own], "n_leaves": n_leaves[own], "saved_tokens": saved[own]})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (e1, e2, conv_id) to runs of at most ``RUN_IDS`` ids of one node: (e1, e2, first id, ids joined by commas)."""
    for b in batches:
        e1, e2, ids = (b.column(k).to_numpy() for k in range(3))
        heads = np.flatnonzero(np.append(True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1]))[: len(e1)])
        cuts = np.unique(np.concatenate([np.arange(a, z, RUN_IDS) for a, z in zip(heads, np.append(heads[1:], len(e1)))] or [heads])).astype(np.int64)
        texts = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(cuts, np.append(cuts[1:], len(e1)))]
        yield pa.RecordBatch.from_arrays([pa.array(e1[cuts]), pa.array(e2[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], names=["e1", "e2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (e1, e2, first) to the hash of all ids of each node; only one hash is open at a time."""
    row = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int64()), pa.array([k[1]], pa.int64()), pa.array([h.hexdigest()])], names=["e1", "e2", "ends"])
    at, digest = None, None
    for b in batches:
        for e1, e2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if at != (e1, e2):
                if at:
                    yield row(at, digest)
                at, digest = (e1, e2), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if at:
        yield row(at, digest)


def ends_of(ends: DataFrame) -> DataFrame:
    """e1, e2, ends: SHA-256 of the conv_ids of each (e1, e2), ascending, joined by commas."""
    runs = ends.select("e1", "e2", "conv_id").repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id").mapInArrow(_joined, "e1 bigint, e2 bigint, first bigint, ids string")
    return runs.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(_hashed, "e1 bigint, e2 bigint, ends string")


def trie(turns: DataFrame, ids: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each distinct prefix of conversations, given by their turns (conv_id, d from 1, m, w) and their ids (those without turns too): conv_id (the smallest that begins so), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    p, q, s = ["p1", "p2"], ["q1", "q2"], ["s1", "s2"]
    steps = written(prefixes(turns), "trie-prefixes")
    last = steps.groupBy("conv_id").agg(F.max(F.struct("d", *p, "cw")).alias("l")).select("conv_id", F.col("l.d").alias("turns"), F.col("l.p1").alias("e1"), F.col("l.p2").alias("e2"), F.col("l.cw").alias("words"))
    ends = written(ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("turns", "e1", "e2", "words")]), "trie-ends")
    sequences = ends.groupBy("e1", "e2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("turns").alias("turns"), F.max("words").alias("words"))
    rows = steps.join(sequences.drop("e1", "e2"), "conv_id")
    shared = rows.groupBy(*p).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = written(rows.join(shared, p, "left").withColumn("k", F.coalesce("k", F.lit(1))), "trie-rows")
    # Turns that go into a trie: all shared ones and the first that is not (the head of the tail).
    rows = rows.join(rows.groupBy("conv_id").agg((F.count_if(F.col("k") > 1) + 1).alias("top")), "conv_id")
    weight = rows.where("k > 1").groupBy(*p).agg(F.sum(F.least("top", "turns") - F.col("d") + 1).alias("weight"))
    rows = rows.join(weight, p, "left")
    cut = rows.where((F.col("k") == 1) | (F.col("weight") <= shard_rows)).groupBy("conv_id").agg(F.min(F.struct("d", *p)).alias("c"))
    rows = rows.join(cut.select("conv_id", F.col("c.d").alias("cut"), F.col("c.p1").alias("s1"), F.col("c.p2").alias("s2")), "conv_id", "left").withColumn("cut", F.coalesce("cut", F.col("turns") + 1))
    rows = written(rows.drop("weight"), "trie-shards")
    rest = (F.col("n") - 1) * (F.col("words") - F.col("cw") + F.col("w"))
    below = rows.where("d >= cut AND d <= top").withColumns({"tail": F.col("k") == 1, "tail_saved": rest, "more": (F.col("turns") > F.col("d")).cast("bigint")})
    tasks = max(1, below.count() // shard_rows)
    grouped = below.select(*s, "conv_id", "d", "m", "w", *p, *q, "n", "tail", "tail_saved", "more", F.pmod(F.xxhash64(*s), F.lit(tasks)).alias("task")).groupBy("task")
    nodes = written(grouped.applyInArrow(lambda t: summed(t.drop_columns(["task"])), NODES), "trie-nodes")
    tails = rows.where("d > top").select(*p, *q, "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("turns") > F.col("d")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), rest.alias("saved_tokens"))
    upper = _upper(rows, sequences, nodes)
    over = upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    # Tops of shards and nodes above them have their parents above; the others know theirs.
    above = upper.unionByName(nodes.where("parent_conv_id IS NULL")).join(over, q, "left").withColumn("parent_conv_id", F.col("parent")).drop("parent")
    found = above.unionByName(nodes.where("parent_conv_id IS NOT NULL")).unionByName(tails)
    one = sequences.where("n = 1").select("e1", "e2", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    several = ends.join(sequences.where("n > 1").select("e1", "e2"), ["e1", "e2"])
    hashes = one.unionByName(ends_of(several)).select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), "ends")
    return found.join(hashes, p, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _upper(rows: DataFrame, sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes above the shards, the root (named 0, 0) among them."""
    zero = F.lit(0).cast("bigint")
    root = sequences.select("conv_id", zero.alias("d"), zero.alias("w"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"), "n")
    steps = rows.where("d < cut").select("conv_id", "d", "w", "p1", "p2", "q1", "q2", "n").unionByName(root)
    tops = steps.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("d"), F.sum("n").alias("n_convs"), F.max("w").alias("w"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    heads = nodes.where("parent_conv_id IS NULL")
    given = tops.select("conv_id", "d", ((F.col("n_convs") - 1) * F.col("w")).alias("saved"), zero.alias("leaves")).unionByName(heads.select("conv_id", (F.col("depth") - 1).alias("d"), F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")))
    given = given.groupBy("conv_id", "d").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    flows = steps.select("conv_id", "d", "p1", "p2").join(given, ["conv_id", "d"], "left").select("p1", "p2", F.sum("saved").over(down).alias("saved"), F.sum("leaves").over(down).alias("leaves"))
    sums = flows.groupBy("p1", "p2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("leaves"))
    children = tops.where("q1 IS NOT NULL").select("q1", "q2").unionByName(heads.select("q1", "q2")).groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    all_ = tops.join(sums, ["p1", "p2"]).join(children, ["p1", "p2"], "left")
    count = F.coalesce("n_children", F.lit(0))
    return all_.select("p1", "p2", "q1", "q2", "conv_id", F.col("d").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", count.alias("n_children"), F.when(count == 0, F.lit(1)).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``trie`` of conversations (conv_id, turn, role, text) as ``rebuilt``.

    Rows with a null conv_id belong to no conversation. Null turns come first; null roles and texts are empty; turns of equal order go by the MD5 of role and text. Repeated
    rows are turns of their own. Other columns are not read. An empty table has no nodes.
    """
    return trie(*rebuilt(*placed(conversations)), shard_rows)
