"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are parted by size into classes of powers of two. An item's sketch is its ``m`` smallest shingle hashes under a seed, where
``m`` follows from its class: an item of which a document holds the share ``containment`` lacks at most ``(1 - containment) * upper size``
shingles there, so with ``need`` more than that in the sketch at least ``need`` of them are found, and no leak is lost. Texts
that hold ``need`` sketch shingles of an item are candidates, whose containment is then counted exactly.

1. Items are written as sets and sketches. A Bloom filter of all their shingles, of at most ``FILTER_BITS`` bits whatever their number, goes with the tasks.
2. One pass over the documents keeps of each text the distinct shingles that pass the filter; most texts have none. Equal texts are one from here on.
3. Those shingles meet the sketches in a join; pairs that share enough are verified on whole sets in a second join.

Items may be of any number: beyond what the filter can tell apart more shingles pass it, and the joins, which are exact, still sort them out. Words are
runs of bytes outside white space with A-Z lower-cased; an item of fewer words than a shingle is one shingle of its own width.

Null texts hold nothing, and null items and items without words are in no document. Texts are told apart by 128 bits, shingles by 64. Repeated rows
of either table give repeated pairs. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, broadcast_if_small, hashed_words, mixed, shingle_sets, shingled, texts_of, written

SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the largest filter (16 MB); a smaller one has 256 to 512 bits for each shingle, so few others pass.
FILTER_BITS = 1 << 27


def _sketches(width: int, containment: float, need: int):
    """Items as rows of (row, key, width, size, required, need, tokens, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for part in blocks(texts):
                rows = []
                for k, (t, s) in enumerate(zip(texts[part], shingle_sets(texts[part], width), strict=True)):
                    if not len(s):
                        continue
                    upper = (1 << len(s).bit_length()) - 1  # of the item's size class
                    required = -(-int(round(containment * 10_000)) * len(s) // 10_000)
                    sketch = s[np.argsort(mixed(s ^ SEED), kind="stable")[: int((1 - containment) * upper) + need]]
                    rows.append((part.start + k, min(width, len(t.split())), len(s), required, max(1, min(need, len(sketch) - (len(s) - required))), s.view(np.int64), sketch.view(np.int64)))
                at, widths, sizes, required, needs, tokens, sketches = zip(*rows, strict=True) if rows else [()] * 7
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (tokens, sketches)]
                numbers = [pa.array(list(x), pa.int64()) for x in (widths, sizes, required, needs)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(at), pa.int64())), *numbers, *lists], names=["item_", "width_", "size_", "required_", "need_", "tokens_", "sketch_"])

    return run


def _bits(codes: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places in a filter of ``size`` bits for each code."""
    h = mixed(codes ^ SEED)
    return [(h % np.uint64(size)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)]


def _filter_of(items: DataFrame) -> np.ndarray:
    """The Bloom filter: its bytes are summed up by Spark, and only those that are not zero come to the driver."""
    n = items.agg(F.sum("size_")).first()[0] or 0
    size = min(FILTER_BITS, max(1 << 10, 1 << int(256 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array((1 << (at & 7)).astype(np.int32))], names=["byte_", "bit_"])

    found = items.select("tokens_").mapInArrow(run, "byte_ bigint, bit_ int").groupBy("byte_").agg(F.bit_or("bit_").alias("bits_")).toArrow()
    out = np.zeros(size >> 3, np.uint8)
    out[found["byte_"].to_numpy()] = found["bits_"].to_numpy().astype(np.uint8)
    return out


def _hits(held: np.ndarray, widths: list[int], width: int):
    """Texts as (t1_, t2_, distinct shingles that pass the filter), those that have some."""
    size = len(held) << 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(2))
            for part in blocks(texts):
                words, starts = hashed_words(texts[part], lower=True)
                text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                codes, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for w in widths:
                    hashes = shingled(words, w) ^ np.uint64(0 if w == width else w)
                    if not len(hashes):
                        continue
                    passed = text_of[: len(hashes)] == text_of[w - 1 :]
                    for place in _bits(hashes, size):
                        passed &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    codes.append(hashes[passed])
                    of.append(text_of[: len(hashes)][passed])
                codes, of = np.concatenate(codes), np.concatenate(of)
                order = np.lexsort((codes, of))
                codes, of = codes[order], of[order]
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
                some, first = np.unique(of[new], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, new.sum()), pa.int32()), pa.array(codes[new].view(np.int64)))
                ids = [b.column(i)[part.start : part.stop].take(pa.array(some)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, lists], names=["t1_", "t2_", "held_"])

    return run


def _text_id(text: str) -> list[Column]:
    return [F.xxhash64(F.col(text)).alias("t1_"), F.xxhash64(F.lit(1), F.col(text)).alias("t2_")]


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, containment: float = 0.8, need: int = 3) -> DataFrame:
    """t1_, t2_ (of ``_text_id``), item_, size_, shared_ for each distinct text and each row of items that it holds, as a written table."""
    kind = items.schema[item_key].dataType.simpleString()
    sketched = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_"), F.col(item_text).alias("text_"))
    sketched = sketched.mapInArrow(_sketches(width, containment, need), f"item_ {kind}, width_ bigint, size_ bigint, required_ bigint, need_ bigint, tokens_ array<bigint>, sketch_ array<bigint>")
    own = written(sketched.withColumn("row_", F.monotonically_increasing_id()), "benchmark-items")
    widths = sorted(r[0] for r in own.select("width_").distinct().collect())  # at most as many as ``width``
    hits = docs.where(F.col(text).isNotNull()).select(*_text_id(text), F.col(text).alias("text_")).mapInArrow(_hits(_filter_of(own), widths, width), "t1_ bigint, t2_ bigint, held_ array<bigint>")
    hits = written(hits.dropDuplicates(["t1_", "t2_"]), "benchmark-hits")

    sketch = own.select("row_", "need_", F.explode("sketch_").alias("token_"))
    met = hits.select("t1_", "t2_", F.explode("held_").alias("token_")).join(sketch, "token_")
    near = met.groupBy("t1_", "t2_", "row_").agg(F.count(F.lit(1)).alias("n_"), F.first("need_").alias("need_")).where("n_ >= need_").select("t1_", "t2_", "row_")
    whole = near.join(hits, ["t1_", "t2_"]).join(own.select("row_", "item_", "size_", "required_", "tokens_"), "row_")
    whole = whole.withColumn("shared_", F.size(F.array_intersect("held_", "tokens_")).cast("bigint")).where("shared_ >= required_")
    return written(whole.select("t1_", "t2_", "item_", "size_", "shared_"), "benchmark-leaks")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, containment: float = 0.8) -> DataFrame:
    """doc key, item key, n_shingles (of the item), n_shared, containment for each document that holds at least ``containment`` of an item's
    distinct shingles. Other columns are not read."""
    found = contained(docs, items, text, item_key, item_text, width, containment)
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key_"), *_text_id(text))
    out = own.join(broadcast_if_small(found), ["t1_", "t2_"])
    return out.select(F.col("key_").alias(key), F.col("item_").alias(item_key), F.col("size_").alias("n_shingles"), F.col("shared_").alias("n_shared"), (F.col("shared_") / F.col("size_")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 5, containment: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; null texts stay."""
    names = docs.columns
    found = contained(docs, items, text, item_key, item_text, width, containment).select("t1_", "t2_").distinct()
    whole = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(names)], *_text_id(text))
    text_ = F.col(f"c{names.index(text)}_")
    gone = broadcast_if_small(found).withColumnsRenamed({"t1_": "g1_", "t2_": "g2_"})
    kept = whole.join(gone, (F.col("t1_") == F.col("g1_")) & (F.col("t2_") == F.col("g2_")) & text_.isNotNull(), "left_anti")
    return kept.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])
