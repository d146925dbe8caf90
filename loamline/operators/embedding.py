"""Vectors for chunks by a model that the user brings, kept in a cache by a hash of what was embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.identity import valid_vector

#: Why a chunk has no vector.
REASONS = {"imports": "imports-only", "structural": "structural-only"}


@dataclass(frozen=True)
class Embedder:
    """``embed`` gives a vector of ``dimensions`` numbers for each of some texts; it is sent to the tasks."""

    model: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]


def skip_reason(kind: Column, enabled: bool = True) -> Column:
    """Null for what is to be embedded."""
    if not enabled:
        return F.lit("embedding-disabled")
    found = F.lit(None).cast("string")
    for name, reason in REASONS.items():
        found = F.when(kind == name, F.lit(reason)).otherwise(found)
    return found


def input_hash(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), text), 256)


def misses(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct rows of ``inputs`` (input_hash, ...) that the cache lacks."""
    return inputs.dropDuplicates(["input_hash"]).join(cache.select("input_hash"), "input_hash", "left_anti")


def vectors(inputs: DataFrame, embedder: Embedder, text: str = "search_text", batch: int = 256) -> DataFrame:
    """input_hash, embedding of each row; a model that gives another number of vectors or dimensions is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                found = [[float(x) for x in v] for v in embedder.embed(part.column(1).to_pylist())]
                if len(found) != part.num_rows or any(len(v) != embedder.dimensions for v in found):
                    raise ValueError(f"{embedder.model} did not give {embedder.dimensions} numbers for each text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], names=["input_hash", "embedding"])

    return inputs.select("input_hash", text).mapInArrow(run, "input_hash string, embedding array<double>")


def embedded(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``chunks`` (chunk_kind, search_text, ...) with embedding, embedding_status, embedding_skip_reason, and the vectors that the cache lacked.

    Equal texts are embedded once. Vectors, cached ones too, that are not finite or of other dimensions are errors when they are read. Chunks
    without a text are embedded as empty ones. Write the second table to the cache before reading the first, which reads both.
    """
    text = F.coalesce("search_text", F.lit(""))
    own = chunks.withColumn("embedding_skip_reason", skip_reason(F.col("chunk_kind")))
    own = own.withColumn("input_hash", F.when(F.col("embedding_skip_reason").isNull(), input_hash(F.lit(f"{embedder.model}/{embedder.dimensions}"), text)))
    wanted = own.where("input_hash IS NOT NULL").select("input_hash", text.alias("search_text"))
    new = vectors(misses(wanted, cache) if cache is not None else wanted.dropDuplicates(["input_hash"]), embedder)
    known = new if cache is None else new.unionByName(cache.select("input_hash", "embedding"))
    checked = F.when(valid_vector(F.col("embedding"), embedder.dimensions), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("not a valid vector: "), "input_hash")))
    # What is skipped has no hash to join by, and would all meet in one task.
    with_vector = own.where("input_hash IS NOT NULL").join(known.withColumn("embedding", checked), "input_hash", "left")
    rest = own.where("input_hash IS NULL").withColumn("embedding", F.lit(None).cast("array<double>"))
    status = F.when(F.col("embedding_skip_reason").isNull(), "embedded").otherwise("skipped")
    return with_vector.unionByName(rest).withColumn("embedding_status", status), new
