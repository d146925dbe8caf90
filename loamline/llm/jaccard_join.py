"""N-gram Jaccard join with prefix filters under several global token orders, and the components of its links.

Documents with equal shingle sets are one class. A link needs ``percent`` of the union in common, so of A's shingles at most
``len(A) - ceil(percent * len(A))`` are not in its partner, and under any global order the first so many plus ``more`` of two sets of one size
share ``more``; of two sizes, one less at least:

1. order of a seeded hash: a class stays if enough of its prefix shingles are also in the prefixes of other classes;
2. order of document frequency among the classes that stay (rarest first): classes that share a prefix shingle are candidates;
3. order of another seeded hash: candidates must share a shingle of its prefixes too.

Only pairs that pass all three are verified on whole sets. To spare groups of many near copies from being paired out, each shingle's classes
first meet only its most common-looking class (fewest shingles of its own); then components that share a shingle are paired, and of these the
classes that have it, within the size and position bounds of the order. All links between components are found, so components are exact.

Words are runs of bytes outside white space with A-Z lower-cased; sets are compared by 64-bit hashes of shingles, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, broadcast_if_small, mixed, shingle_sets, text_blocks, written
from .components import components

SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))
BLOCK_BYTES = 2 << 20
#: Hashes go to Spark as bigint.
BIGINT = np.int64


def least_common(n, percent: int):
    """ceil(percent / 100 * n): what a set of ``n`` shares with a partner at least."""
    return (n * percent + 99) // 100


def extra(n, percent: int):
    """Shingles beyond the shortest prefix that the first order takes: as many again, so that half of them must be shared."""
    return n - least_common(n, percent)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a sorted set."""
    both = [Spans(mixed(s ^ seed)).of(np.array([0]), np.array([len(s)]))[0] for seed in SEEDS]
    return tuple(int(x) for x in np.array(both).view(BIGINT))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for part, texts in text_blocks(b.column(1), BLOCK_BYTES):
            yield b.slice(part.start, part.stop - part.start), shingle_sets(texts, width)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, width):
            pairs = [signature(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["key_", "t_", "n", "s1", "s2"]
            )

    return run


def _first_prefixes(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            tokens, owners, seen = [np.zeros(0, np.uint64)], [np.zeros(0, BIGINT)], set()
            for s in sets:
                if not len(s) or (own := signature(s)[0]) in seen:
                    continue
                seen.add(own)
                size = len(s) - least_common(len(s), percent) + 1 + extra(len(s), percent)
                scrambled = mixed(s ^ SEEDS[0])
                tokens.append(s[np.argpartition(scrambled, size - 1)[:size]] if size < len(s) else s)
                owners.append(np.full(min(size, len(s)), own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(BIGINT)), pa.array(np.concatenate(owners))], names=["token", "s1"])

    return run


def _whole_sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            rows = [(*signature(s), s) for s in sets if len(s)]
            second = [s[np.argsort(mixed(s ^ SEEDS[1]))[: len(s) - least_common(len(s), percent) + 1]] for *_, s in rows]
            lists = lambda xs: pa.array([x.view(BIGINT) for x in xs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], lists([r[2] for r in rows]), lists(second)], names=["s1", "s2", "tokens", "second"])

    return run


def classes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key_, t_ (hash of the text), n (shingles), s1 and s2 (signature; null for empty sets) for each row, as a written table."""
    own = docs.select(F.col(key).cast("bigint").alias("key_"), F.col(text).alias("text_"), F.xxhash64(text).alias("t_"))
    return written(own.mapInArrow(_signed(width), "key_ bigint, t_ bigint, n bigint, s1 bigint, s2 bigint"), "jaccard-classes")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those that share a prefix shingle under the second hash order and then enough of their whole sets."""
    side = lambda name, *columns: sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    near = pairs.join(side("a", "second"), "a").join(side("b", "second"), "b").where(F.arrays_overlap("a_second", "b_second")).select("a", "b")
    whole = near.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return whole.where(shared * 100 >= (F.size("a_tokens") + F.size("b_tokens") - shared) * percent).select("a", "b")


def _alike_in_size(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _across(known: DataFrame, percent: int) -> DataFrame:
    """(a, b) for classes of different components that share a prefix shingle and can be linked by their sizes and its places.

    Components are paired first, then their classes, so that no two classes of one component meet, however many have the shingle.
    """
    enough = lambda n, m: F.floor((n + m) * percent / (100 + percent))
    several = known.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("token")
    open_ = written(known.join(several, "token").select("token", "node", "c", "n", (F.col("n") - F.col("at")).alias("left")), "jaccard-open")
    side = lambda df, name: df.select("token", *[F.col(x).alias(f"{name}_{x}") for x in df.columns if x != "token"])
    # Of a component the sizes that its classes with the shingle reach, and the most shingles from it on.
    of = open_.groupBy("token", "c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("far"))
    col = F.col
    alike = (col("a_high") * 100 >= col("b_low") * percent) & (col("b_high") * 100 >= col("a_low") * percent)
    pairs = side(of, "a").join(side(of, "b"), "token").where((col("a_c") < col("b_c")) & alike & (F.least("a_far", "b_far") >= enough(col("a_low"), col("b_low"))))
    alike = (col("a_n") * 100 >= col("b_low") * percent) & (col("b_high") * 100 >= col("a_n") * percent)
    half = pairs.drop("a_low", "a_high", "a_far").join(side(open_, "a"), ["token", "a_c"]).where(alike & (F.least("a_left", "b_far") >= enough(col("a_n"), col("b_low"))))
    met = half.drop("b_low", "b_high", "b_far").join(side(open_, "b"), ["token", "b_c"]).where(_alike_in_size(col("a_n"), col("b_n"), percent) & (F.least("a_left", "b_left") >= enough(col("a_n"), col("b_n"))))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def linked(docs: DataFrame, own: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that may have links (s1, s2, node), and node, component for those that have; enough links for exact components are found, not
    all inside one."""
    texts = docs.select(F.col(key).cast("bigint").alias("key_"), F.col(text).alias("text_"), F.xxhash64(text).alias("t_"))
    prefixes = texts.mapInArrow(_first_prefixes(width, percent), "token bigint, s1 bigint")
    alone = prefixes.groupBy("token").agg(F.min("s1").alias("s1"), F.max("s1").alias("other")).where("s1 = other")
    first = own.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("key_", "t_")).alias("row"), F.min("n").alias("n"))
    # Sets whose first hashes are equal by chance are counted together; they stay, and are told apart from then on.
    counts = lambda df, alone, sets: df.select("s1", F.lit(alone).alias("alone"), F.lit(sets).alias("sets"))
    alone = counts(alone, 1, 0).unionAll(counts(first, 0, 1)).groupBy(F.col("s1").alias("of_")).agg(F.sum("alone").alias("alone"), F.sum("sets").alias("sets"))
    lack = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    more = lack
    taken = F.least(F.col("n"), lack + 1 + more)
    # Partners of other sizes have other prefixes: of linked sets the larger may share one less than its own surplus, from half the union up.
    need = F.greatest(F.lit(1), more) if percent >= 50 else F.lit(1)
    stay = first.join(alone, F.col("s1") == F.col("of_")).where((F.col("sets") > 1) | (taken - F.col("alone") >= need))
    stay = stay.select("s1", "s2", "row.key_", "row.t_", F.xxhash64("row.key_", "row.t_").alias("h_"), F.monotonically_increasing_id().alias("node"))
    stay = written(stay, "jaccard-stay")

    # One row of each class, by a hash of key and text: rows that repeat a key would each meet all classes of that key.
    asked = texts.withColumn("h_", F.xxhash64("key_", "t_")).join(broadcast_if_small(stay.select("h_")), "h_", "left_semi").select("key_", "text_")
    sets = asked.mapInArrow(_whole_sets(width, percent), "s1 bigint, s2 bigint, tokens array<bigint>, second array<bigint>").dropDuplicates(["s1", "s2"])
    sets = written(sets.join(stay.select("s1", "s2", "node"), ["s1", "s2"]).select("node", "tokens", "second"), "jaccard-sets")

    spread = sets.select("node", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spread.join(common, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("token").alias("h"), "token"))).alias("ranked"))
    n = F.size("tokens")
    ranked = sets.select("node", n.cast("bigint").alias("n")).join(ranked, "node").withColumn("u", F.col("n") - F.size("ranked"))
    room = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - F.col("u")
    prefix = ranked.where(room > 0).select("node", "n", "u", F.posexplode(F.slice("ranked", F.lit(1), room.cast("int"))).alias("j", "r"))
    prefix = written(prefix.select("node", "n", "u", (F.col("u") + F.col("j")).alias("at"), F.col("r.token").alias("token")), "jaccard-prefixes")

    lead = prefix.groupBy("token").agg(F.min(F.struct("u", "node", "n")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("l.node").alias("b"), F.col("l.n").alias("m"))
    stars = prefix.join(lead, "token").where((F.col("node") != F.col("b")) & _alike_in_size(F.col("n"), F.col("m"), percent))
    stars = stars.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    links = written(_verified(stars, sets, percent), "jaccard-links")

    labels = written(components(links), "jaccard-labels")
    named = labels.withColumnRenamed("node", "of_")
    known = prefix.join(named, prefix.node == named.of_, "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("c"))
    late = written(_verified(_across(known, percent), sets, percent), "jaccard-links")
    # Labels stand for the links that gave them.
    labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
    return stay.select("s1", "s2", "node"), labels


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``key``, n_shingles, component_id (smallest ``key`` reachable by links) for each row.

    A text of fewer words than ``width`` has its whole sequence as its one shingle; one without words, or null, has none and is
    linked with nothing. Rows of equal sets are linked. Rows that repeat a key are judged apart. Null keys: the component is the
    smallest key that is not null, or null. Other columns are not read; an empty table gives an empty result.
    """
    own = classes(docs, key, text, width)
    stay, labels = linked(docs, own, key, text, width, percent)
    least = own.where("n > 0").groupBy("s1", "s2").agg(F.min("key_").alias("k"))
    of = stay.join(labels, "node").select("s1", "s2", "component")
    named = written(least.join(of, ["s1", "s2"], "left"), "jaccard-named")
    # Classes without links are components of their own.
    lone, joined = named.where("component IS NULL"), named.where("component IS NOT NULL")
    joined = joined.join(joined.groupBy("component").agg(F.min("k").alias("component_id")), "component").select("s1", "s2", "component_id")
    found = joined.unionAll(lone.select("s1", "s2", "k"))
    return own.join(found, ["s1", "s2"], "left").select(F.col("key_").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key_")).alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents, that of the smallest key, all columns; rows without words all stay.

    Rows that repeat the smallest key with equal texts stay as often as they are there.
    """
    found = grouped(docs, key, text, width, percent)
    stays = (F.col("n_shingles") == 0) | F.col(key).eqNullSafe(F.col("component_id"))
    gone = found.groupBy(F.col(key).alias("gone_")).agg(F.max(stays).alias("stays")).where("NOT stays").select("gone_")
    gone = broadcast_if_small(written(gone, "jaccard-gone"))
    return docs.join(gone, F.col(key).eqNullSafe(F.col("gone_")), "left_anti")
