"""Integrity of a build, as one row (check_name, id, detail) for each violation; a build without rows is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.identity import base64, build_id, chunk_id, content_hash, file_id, valid_vector
from loamline.functions.text import enrichment, newlines

from .chunking import MOST, counted
from .embedding import skip_reason


def _row(df: DataFrame, name: str, id_: str, detail) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.col(id_).cast("string").alias("id"), detail.cast("string").alias("detail"))


def duplicates(records: DataFrame, id_: str = "id") -> DataFrame:
    many = records.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _row(many, "duplicate-id", id_, F.col("n"))


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return _row(chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti"), "orphan-chunk", "id", F.col("file_id"))


def gaps(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes that no chunk covers: a chunk that starts after all before it end, or a file whose chunks stop short."""
    before = Window.partitionBy("file_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    late = chunks.withColumn("covered", F.coalesce(F.max("end_byte").over(before), F.lit(0))).where("start_byte > covered")
    reach = chunks.groupBy("file_id").agg(F.max("end_byte").alias("reach"))
    short = files.join(reach, files.id == reach.file_id, "left").where(F.coalesce("reach", F.lit(0)) != F.col("byte_length"))
    return _row(late, "coverage-gap", "id", F.col("covered")).unionByName(_row(short, "coverage-short", "id", F.coalesce("reach", F.lit(0))))


def _failed(df: DataFrame, id_: str, tests: dict) -> DataFrame:
    """A row for each of ``tests`` (name: (wrong, detail)) that a row of ``df`` fails, in one pass."""
    found = [F.when(wrong, F.struct(F.lit(name).alias("check_name"), detail.cast("string").alias("detail"))) for name, (wrong, detail) in tests.items()]
    each = df.select(F.col(id_).cast("string").alias("id"), F.array_compact(F.array(*found)).alias("found_"))  # what tests share is worked out once in a projection
    return each.select("id", F.explode("found_").alias("x")).select("x.check_name", "id", "x.detail")


def violations(files: DataFrame, chunks: DataFrame, inventory: DataFrame, config_hash: str) -> DataFrame:
    """``files`` (id, path, content_hash, byte_length, chunk_count, source_text, config_hash), ``chunks``, ``inventory`` (path, status, file_id, content_hash)."""
    lean = files.select("id", "path", "content_hash", "byte_length", "chunk_count", "config_hash", content_hash(F.col("source_text")).alias("digest_"), F.octet_length("source_text").alias("size_"))  # joined without texts
    digest, size = F.col("digest_"), F.col("size_")
    counts = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    listed = inventory.where("status = 'included'").select(F.col("file_id").alias("listed_id"), F.col("path").alias("listed_path"), F.col("content_hash").alias("listed_hash"))
    f = lean.join(counts, lean.id == counts.file_id, "left").drop("file_id").join(listed, F.col("id") == F.col("listed_id"), "full_outer")
    there, n = F.col("id").isNotNull(), F.coalesce("n", F.lit(0))
    of_files = _failed(f.withColumn("which", F.coalesce("id", "listed_id")), "which", {
        "file-content-hash": (there & (digest != F.col("content_hash")), digest),
        "file-byte-length": (there & (size != F.col("byte_length")), size),
        "file-id": (there & (file_id(base64(F.col("path")), F.col("content_hash")) != F.col("id")), F.col("path")),
        "file-config": (there & (F.col("config_hash") != config_hash), F.col("config_hash")),
        "file-missing": (~there, F.col("listed_path")),
        "file-not-listed": (F.col("listed_id").isNull(), F.col("path")),
        "file-inventory": ((F.col("path") != F.col("listed_path")) | (F.col("content_hash") != F.col("listed_hash")), F.col("path")),
        "chunk-count": (there & (n != F.col("chunk_count")), n),
        "chunk-ordinals": (there & ((F.col("first") != 0) | (F.col("last") != F.col("n") - 1)), F.col("last")),
    })
    own = files.select(F.col("id").alias("of_file"), F.encode("source_text", "UTF-8").alias("bytes_"), "byte_length", F.col("content_hash").alias("of_hash"), F.col("path").alias("of_path"))
    c = chunks.join(own, F.col("file_id") == F.col("of_file"))
    start, end, data, body = F.col("start_byte"), F.col("end_byte"), F.col("bytes_"), F.col("body_")
    # The file is encoded once, and what stands before a chunk is gone through once; the last line is found from the first.
    low, high = F.greatest(start, F.lit(0)), F.greatest(start, end - 1, F.lit(0))
    before, inside = newlines(F.substring(data, F.lit(1), low.cast("int"))), newlines(F.substring(data, (low + 1).cast("int"), (high - low).cast("int")))
    c = c.select(*chunks.columns, "byte_length", "of_hash", "of_path", F.substring(data, (start + 1).cast("int"), (end - start).cast("int")).cast("string").alias("body_"), before.alias("before_"), inside.alias("inside_"))
    again = chunk_id(F.col("file_id"), F.col("config_hash"), start, end, F.col("ordinal"))
    of_chunks = _failed(c, "id", {
        "chunk-range": ((end <= start) | (start < 0) | (end > F.col("byte_length")), end),
        "chunk-id": (again != F.col("id"), again),
        "chunk-utf8": (~F.is_valid_utf8(body), start),
        "chunk-text": (~F.endswith("search_text", body), start),
        "chunk-prefix": (~F.col("search_text").eqNullSafe(F.concat(enrichment(F.col("path"), F.col("scope"), F.col("symbol")), body)), start),
        "chunk-file": ((F.col("content_hash") != F.col("of_hash")) | (F.col("path") != F.col("of_path")), F.col("path")),
        "chunk-lines": ((start.isNotNull() & (F.col("start_line") != F.col("before_") + 1)) | ((start.isNotNull() | end.isNotNull()) & (F.col("end_line") != F.col("before_") + F.col("inside_") + 1)), F.col("start_line")),
        "chunk-tokens": (F.col("token_count") > MOST, F.col("token_count")),
        "chunk-config": (F.col("config_hash") != config_hash, F.col("config_hash")),
    })
    return reduce(DataFrame.unionByName, [of_files, of_chunks, duplicates(files.select("id").unionByName(chunks.select("id"))), orphans(chunks, files), gaps(chunks, files)])


def records(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Records (id, file_id, hash) against those that the version lists: missing, not listed, of another hash, or of another file."""
    a = listed.select(F.col("id").alias("listed_id"), F.col("file_id").alias("listed_file"), F.col("hash").alias("listed_hash"))
    both = found.select("id", "file_id", "hash").join(a, F.col("id") == F.col("listed_id"), "full_outer")
    there, known = F.col("id").isNotNull(), F.col("listed_id").isNotNull()
    return _failed(both.withColumn("which", F.coalesce("id", "listed_id")), "which", {
        "record-missing": (~there, F.col("listed_hash")),
        "record-not-listed": (~known, F.col("hash")),
        "record-hash": (there & known & ~F.col("hash").eqNullSafe(F.col("listed_hash")), F.col("hash")),
        "record-file": (there & known & ~F.col("file_id").eqNullSafe(F.col("listed_file")), F.col("file_id")),
    })


def identities(builds: DataFrame, builder: str) -> DataFrame:
    """Builds (repository, commit, config, config_hash, build_id) whose commit is no object name, or whose hashes are not those of what they name."""
    config = F.sha2("config", 256)
    again = build_id(F.col("repository"), F.col("commit"), F.col("config_hash"), builder)
    return _failed(builds, "build_id", {
        "commit-form": (~F.coalesce(F.col("commit").rlike(r"\A([a-f0-9]{40}|[a-f0-9]{64})\z"), F.lit(False)), F.col("commit")),
        "config-hash": (~config.eqNullSafe(F.col("config_hash")), config),
        "build-id": (~again.eqNullSafe(F.col("build_id")), again),
    })


def embeddings(chunks: DataFrame, dimensions: int | None) -> DataFrame:
    """Chunks (id, chunk_kind, embedding, embedding_status, embedding_skip_reason) whose state is not the one due, or whose vector is not valid."""
    due, done = skip_reason(F.col("chunk_kind"), dimensions is not None), F.col("embedding_status").eqNullSafe(F.lit("embedded"))
    return _failed(chunks, "id", {
        "embedding-vector": (done & ~valid_vector(F.col("embedding"), dimensions or 0), F.size("embedding")),
        "embedding-state": (~done & (~F.col("embedding_status").eqNullSafe(F.lit("skipped")) | F.col("embedding").isNotNull()), F.col("embedding_status")),
        "embedding-reason": (~F.col("embedding_skip_reason").eqNullSafe(due) | (done & due.isNotNull()), F.col("embedding_skip_reason")),
    })


def recount(chunks: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Chunks whose token count is not that of their search text."""
    return _row(counted(chunks.select("id", "search_text", "token_count"), tokenizer).where("n_tokens <> token_count"), "chunk-recount", "id", F.col("n_tokens"))
