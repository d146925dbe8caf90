"""Lexical search: an inverted index as tables, BM25 over the terms of a query, exact filters, top k with an early stop.

An index is written once, as packed rows in order of terms and blocks, and one row of totals. A block is some documents of like length that one task has met together, the same for
all terms. A row is a term in a block: its header (how many documents have the term there, its highest tf, the least length, and the attributes' values as bits), and the slots of
those documents in the block with their tf. One more row for a block, without a term, has the documents of its slots. So no posting is a row of its own, and none is shuffled:
texts are dealt over the tasks, and each packs and sorts its own.

A query reads the headers of its terms and knows from them the most that a document of a block can score. The few blocks that promise most are scored first; blocks that
promise less than the k-th best score found there, or lack the value of a filter, are passed over: by a join with the blocks that stay, and before it by ranges of blocks that the
scan is given. What is left out cannot be among the best, so results are those of all postings.

Every part of a query is literal. Terms are lower-cased runs of letters, digits and ``_`` that single dots or apostrophes may join, so
``code.ts`` is one term. Scores: k1 1.2, b 0.75, idf ln(1 + (N - df + 0.5) / (df + 0.5)); any term matches; ties go by id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def query_terms(text: str, limit: int) -> list[str]:
    if not 1 <= len(text) <= 4096:
        raise ValueError("a query has 1 to 4096 characters")
    if not 1 <= limit <= 100:
        raise ValueError("a limit is 1 to 100")
    return sorted(set(re.findall(r"\w+(?:[.']\w+)*", text.lower())))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counted(t: Column) -> Column:
    """Each distinct term of an array with how often it is there: in sorted order, the distances between the heads of runs."""

    def runs(s: Column) -> Column:
        heads = F.array_compact(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1) != x), j)))
        tf = lambda hs, at, m: (F.coalesce(F.get(hs, m + 1), F.size(s)) - at).cast("bigint")
        return _let(heads, lambda hs: F.transform(hs, lambda at, m: F.struct(F.get(s, at).alias("term"), tf(hs, at, m).alias("tf"))))

    return _let(F.sort_array(t), runs)


def postings(docs: DataFrame, id_: str = "id", text: str = "search_text", attributes: tuple[str, ...] = ()) -> DataFrame:
    """term, id, tf, length (terms of the document) and its ``attributes``. Each text is counted in its own row, without a shuffle; ids are unique."""
    kept = [F.col(a).cast("string").alias(a) for a in attributes]
    each = docs.select(F.col(id_).alias("id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("t"), *kept)
    found = each.select("id", F.size("t").cast("bigint").alias("length"), *attributes, F.explode(_counted(F.col("t"))).alias("p"))
    return found.select("p.term", "id", "length", "p.tf", *attributes)


def _bit(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(value), F.lit(64)).cast("int"))


def _groups(lengths: np.ndarray, documents: int, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most so many documents and words; a longer text is one of its own."""
    ends, a = np.concatenate([[0], np.cumsum(lengths)]), 0
    while a < len(lengths):
        b = min(int(np.searchsorted(ends, ends[a] + words, "right")) - 1, a + documents, len(lengths))
        yield a, max(a + 1, b)
        a = max(a + 1, b)


def _packed(documents: int, words: int, attributes: tuple[str, ...], names: list[str]):
    """Rows (id, t, attributes and their bits) as rows of an index, by sorting numbers; at most ``words`` terms at a time."""

    def rows(b: pa.RecordBatch, lengths: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
        # Documents by length: the place of one is its block and slot. Postings are numbers too, (term, block, slot), and equal ones are counted.
        order = np.argsort(lengths, kind="stable")
        place, blocks = np.empty(len(order), np.int64), -(-len(order) // documents)
        place[order] = np.arange(len(order))
        found = pc.list_flatten(b.column("t")).dictionary_encode()
        size, bits = lengths[order], {f"{a}_bits": b.column(f"{a}_bits").to_numpy()[order] for a in attributes}
        keys = found.indices.to_numpy().astype(np.int64) * (blocks * documents) + np.repeat(place, lengths)
        keys.sort()
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        tf, keys = np.diff(heads, append=len(keys)).astype(np.int32), keys[heads]
        at = np.flatnonzero(np.diff(keys // documents, prepend=-1))
        where, ends = keys % (blocks * documents), np.append(at, len(keys)).astype(np.int32)
        each = {"n": np.diff(ends).astype(np.int64), "block": block + where[at] // documents}
        if len(at):
            each |= {"most": np.maximum.reduceat(tf, at).astype(np.int64), "least": np.minimum.reduceat(size[where], at)}
            each |= {k: np.bitwise_or.reduceat(v[where], at) for k, v in bits.items()}
            lists = {"slots": pa.ListArray.from_arrays(ends, (where % documents).astype(np.int32)), "tfs": pa.ListArray.from_arrays(ends, tf)}
            yield batch({"term": found.dictionary.take(pa.array(keys[at] // (blocks * documents))), **each, **lists}, len(at))
        ends = np.append(np.arange(0, len(order), documents), len(order)).astype(np.int32)
        of = {"ids": b.column("id"), **{a: b.column(a) for a in attributes}}
        held = {k: pa.ListArray.from_arrays(ends, v.take(pa.array(order))) for k, v in of.items()}
        yield batch({"block": block + np.arange(blocks), "n": np.diff(ends).astype(np.int64), "most": np.add.reduceat(size, ends[:-1]), "lengths": pa.ListArray.from_arrays(ends, size), **held}, blocks)

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, types[k]) if k not in columns else pa.array(columns[k]).cast(types[k]) for k in names], names=names)

    types: dict[str, pa.DataType] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            ints = dict.fromkeys(["block", "n", "most", "least", *[f"{a}_bits" for a in attributes]], pa.int64())
            types.update(ints, term=pa.string(), slots=pa.list_(pa.int32()), tfs=pa.list_(pa.int32()), lengths=pa.list_(pa.int64()), ids=pa.list_(b.column("id").type), **{a: pa.list_(pa.string()) for a in attributes})
            lengths = pc.list_value_length(b.column("t")).to_numpy().astype(np.int64)
            for first, end in _groups(lengths, 16 * documents, words):
                yield from rows(b.slice(first, end - first), lengths[first:end], block)
                block += -(-(end - first) // documents)

    return run


class Index:
    """Packed rows and totals under folders that Spark writes: one, or the segments of a version, each with the postings of the texts that it adds.

    ``alive`` leaves out the hits (with segment_, the number of their folder) of texts that later segments have as gone. Their terms are taken off in the headers and totals of
    those segments, so scores are those of an index made anew. ``attributes`` are columns, read as strings, that stand with the documents and that a query may ask to be equal to a
    value.
    """

    #: Documents of a block, at most.
    DOCUMENTS = 1024
    #: Terms that a task packs at a time.
    WORDS = 2_000_000
    #: Blocks that are scored for a threshold.
    FIRST = 16
    #: Ranges of blocks, about, that the scan of a segment is given.
    RANGES = 32
    #: Scores are rounded to this many places; a bound must be below a score by more than that to be passed over.
    PLACES = 6

    def __init__(self, spark: SparkSession, at: str | list[str], alive: Callable[[DataFrame], DataFrame] = lambda hits: hits, id_type: str = "string", attributes: tuple[str, ...] = ()):
        self.spark, self.at, self.alive, self.id_type, self.attributes = spark, [at] if isinstance(at, str) else at, alive, id_type, attributes

    @classmethod
    def write(cls, docs: DataFrame, at: str, id_: str = "id", text: str = "search_text", less: DataFrame | None = None, attributes: tuple[str, ...] = (), near: str | None = None) -> Index:
        """Each text is dealt to a task, whatever files it came in, and cut into terms once. ``less``: texts of earlier segments that are gone. ``near``: an attribute whose equal
        values come to one task, so that they share blocks, for filters of few documents."""
        index = cls(docs.sparkSession, at, id_type=docs.schema[id_].dataType.simpleString(), attributes=attributes)
        kept = [F.col(a).cast("string").alias(a) for a in attributes]
        dealt = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text_"), *kept).repartition(near or "id")
        if near:
            dealt = dealt.sortWithinPartitions(near)
        bits = [_bit(F.col(a)).alias(f"{a}_bits") for a in attributes]
        names = index._schema().split(", ")
        rows = dealt.select("id", terms(F.col("text_")).alias("t"), *attributes, *bits).mapInArrow(_packed(cls.DOCUMENTS, cls.WORDS, attributes, [x.split()[0] for x in names]), index._schema())
        if less is not None:  # gone through once: what each term loses, and what all lose
            cut = less.select(terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
            none = F.struct(F.lit(None).cast("string").alias("term"), F.size("t").cast("bigint").alias("most"))
            each = cut.select(F.inline(F.concat(F.array(none), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(None).cast("bigint").alias("most"))))))
            rows = rows.unionByName(each.groupBy("term").agg((-F.count(F.lit(1))).alias("n"), (-F.sum("most")).alias("most")), allowMissingColumns=True)
        rows.sortWithinPartitions("term", "block").write.parquet(f"{at}/blocks")
        sums = index._rows(at).where("term IS NULL").agg(F.coalesce(F.sum("most"), F.lit(0)).cast("double").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        sums.coalesce(1).write.parquet(f"{at}/totals")
        return index

    def _schema(self) -> str:
        """Of a term in a block: n, most, least, bits, slots, tfs. Of a block (no term): n, most (the terms of all its documents), ids, lengths, attributes by slots. Of a term of texts
        that are gone, or of them all (no block): n, of all also most, less than 0."""
        bits, held = "".join(f", {a}_bits bigint" for a in self.attributes), "".join(f", {a} array<string>" for a in self.attributes)
        return f"term string, block bigint, n bigint, most bigint, least bigint{bits}, slots array<int>, tfs array<int>, ids array<{self.id_type}>, lengths array<bigint>{held}"

    def _rows(self, at: str) -> DataFrame:
        """With its schema, as a segment that adds no text has no file to take it from."""
        return self.spark.read.schema(self._schema()).parquet(f"{at}/blocks")

    def hits(self, wanted: list[str], blocks: DataFrame | None = None) -> DataFrame:
        """Postings of some terms, in some ``blocks`` (segment_, block) if given: term, segment_, block, id, length, tf and attributes."""
        covers = None if blocks is None else self._covers(blocks)
        within = lambda n: F.lit(True) if covers is None else reduce(lambda a, b: a | b, [F.col("block").between(r.low, r.high) for r in covers if r.segment_ == n], F.lit(False))
        rows = lambda which: reduce(DataFrame.unionByName, [self._rows(at).where(which & within(n)).withColumn("segment_", F.lit(n)) for n, at in enumerate(self.at)])
        found = rows(F.col("term").isin(wanted)).select("segment_", "block", "term", "slots", "tfs")
        found = found if blocks is None else found.join(blocks, ["segment_", "block"], "left_semi")
        both = found.join(rows(F.col("term").isNull()).select("segment_", "block", "ids", "lengths", *self.attributes), ["segment_", "block"])
        of = {"id": "ids", "length": "lengths", **{a: a for a in self.attributes}}
        one = lambda x: F.struct(x["tfs"].cast("bigint").alias("tf"), *[F.get(F.col(v), x["slots"]).alias(k) for k, v in of.items()])
        return self.alive(both.select("segment_", "block", "term", F.explode(F.transform(F.arrays_zip("slots", "tfs"), one)).alias("p")).select("term", "segment_", "block", "p.*"))

    def _covers(self, blocks: DataFrame) -> list:
        """segment_, low, high: at most ``RANGES`` + 1 ranges of blocks for each segment, that hold all of ``blocks``."""
        ends = blocks.groupBy("segment_").agg(F.min("block").alias("from_"), (F.max("block") - F.min("block") + 1).alias("span_"))
        cut = blocks.join(F.broadcast(ends), "segment_").groupBy("segment_", F.floor((F.col("block") - F.col("from_")) * self.RANGES / F.col("span_")))  # a row for each segment
        return cut.agg(F.min("block").alias("low"), F.max("block").alias("high")).collect()

    def headers(self, wanted: list[str]) -> DataFrame:
        """Headers of some terms, of all segments (segment_). Those of texts that are gone have no block."""
        read = lambda at: self._rows(at).select("term", "block", "n", "most", "least", *[f"{a}_bits" for a in self.attributes])
        return reduce(DataFrame.unionByName, [read(at).withColumn("segment_", F.lit(n)) for n, at in enumerate(self.at)]).where(F.col("term").isin(wanted))

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{at}/totals" for at in self.at]).agg(F.sum("terms").alias("terms"), F.sum("n").alias("n"))

    def promises(self, wanted: list[str], where: dict[str, str] | None = None) -> DataFrame:
        """segment_, block, n (postings), bound: for each block that may hold a document with a term and the values asked for, the most that one can score."""
        heads = self.headers(wanted)
        rows = heads.where("block IS NOT NULL")
        for a, value in (where or {}).items():
            rows = rows.where(F.col(f"{a}_bits").bitwiseAND(_bit(F.lit(value))) != 0)
        best = rows.select("segment_", "block", "term", F.col("n").alias("count_"), F.col("most").alias("tf"), F.col("least").alias("length"))
        scored = self._contributions(best, heads).withColumnRenamed("count_", "postings")
        return scored.groupBy("segment_", "block").agg(F.sum("postings").alias("n"), F.sum("score").alias("bound"))

    def _contributions(self, rows: DataFrame, heads: DataFrame) -> DataFrame:
        """``rows`` (term, tf, length) with what each adds to a score."""
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))  # a row for each term of the query
        joined = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.totals()))
        norm = K1 * (1 - B + B * F.col("length") * F.col("n") / F.col("terms"))
        score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        return joined.withColumn("score", score).drop("df", "n", "terms")

    def _scored(self, wanted: list[str], blocks: DataFrame, keep: DataFrame | None, where: dict[str, str]) -> DataFrame:
        hits = self.hits(wanted, blocks)
        for a, value in where.items():
            hits = hits.where(F.col(a) == value)
        hits = hits if keep is None else hits.join(keep, "id", "left_semi")
        return self._contributions(hits, self.headers(wanted)).groupBy("id").agg(F.round(F.sum("score"), self.PLACES).alias("score")).orderBy(F.desc("score"), "id")

    def surviving(self, wanted: list[str], limit: int, keep: DataFrame | None = None, where: dict[str, str] | None = None) -> DataFrame:
        """segment_, block: what must be read for the ``limit`` best. The threshold is their least score in the ``FIRST`` blocks that promise most."""
        promised = self.promises(wanted, where)
        first = promised.orderBy(F.desc("bound"), "segment_", "block").limit(self.FIRST + 1).select("segment_", "block").collect()
        named = [F.struct(F.lit(r.segment_).cast("int").alias("segment_"), F.lit(r.block).cast("bigint").alias("block")) for r in first[: self.FIRST]]
        some = self.spark.range(1).select(F.inline(F.array(*named))) if named else promised.select("segment_", "block").limit(0)
        if len(first) <= self.FIRST:
            return some  # all that there are
        top = self._scored(wanted, some, keep, where or {}).limit(limit).collect()
        if len(top) == limit:
            promised = promised.where(F.col("bound") >= top[-1].score - 2 * 10**-self.PLACES)
        return promised.select("segment_", "block")

    def ranked(self, text: str, limit: int = 10, keep: DataFrame | None = None, where: dict[str, str] | None = None) -> DataFrame:
        """id, score of the ``limit`` best, of those with the attributes of ``where`` and in ``keep`` (ids) if given; statistics are those of all documents."""
        for a in where or {}:
            if a not in self.attributes:
                raise ValueError(f"the index has no attribute {a}")
        wanted = query_terms(text, limit)
        return self._scored(wanted, self.surviving(wanted, limit, keep, where), keep, where or {}).limit(limit)


def matching_any(docs: DataFrame, text: str, id_: str = "id", body: str = "search_text") -> DataFrame:
    """Documents that hold any white-space term of the query as a substring, whatever the case."""
    hit = F.lit(False)
    for w in sorted(set(text.lower().split())):
        hit = hit | F.contains(F.lower(F.col(body)), F.lit(w))
    return docs.where(hit).select(F.col(id_).alias("id"), F.lit(1.0).alias("score"))
