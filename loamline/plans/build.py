"""From a tree to the records of a version, taking over what an earlier version already has."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.identity import base64, build_id, canonical_json, content_hash, file_id, multiset_digest
from loamline.functions.text import language
from loamline.operators import chunking, versions
from loamline.sources.tables import stored
from loamline.operators.classify import MAX_BYTES, classified

BUILDER = "loamline-builder-1"


def preset(mode: str = "syntax", max_bytes: int = MAX_BYTES, tokenizer: str | None = None, embedding: dict | None = None) -> dict:
    """``tokenizer``: file of a vocabulary to count by; ``embedding``: model and dimensions."""
    counter = chunking.vocabulary(tokenizer) if tokenizer else chunking.words_and_marks()
    return {"schemaVersion": 1, "mode": mode, "maxFileBytes": max_bytes, "targetTokens": chunking.TARGET, "maxTokens": chunking.MOST, "overlap": chunking.OVERLAP, "counter": counter.name, "embedding": embedding}


def canonical(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()


@dataclass
class Build:
    """Tables of a version. ``changes`` and ``obsolete`` are against ``previous`` and None without one."""

    config: dict
    inventory: DataFrame
    files: DataFrame
    chunks: DataFrame
    changes: DataFrame | None = None
    obsolete: DataFrame | None = None
    tokenizer: str | None = None

    @property
    def config_hash(self) -> str:
        return config_hash(self.config)

    def records(self) -> DataFrame:
        """id, file_id and hash of every record; the hash covers what the record says, not where it is kept."""
        named = lambda df, file, *columns: df.select("id", F.col(file).alias("file_id"), F.sha2(canonical_json(*columns), 256).alias("hash"))
        return named(self.files, "id", "id", "path", "content_hash", "byte_length", "chunk_count", "config_hash", "language").unionByName(
            named(self.chunks, "file_id", "id", "file_id", "start_byte", "end_byte", "start_line", "end_line", "ordinal", "chunk_kind", "scope", "symbol", "search_text", "token_count", "config_hash")
        )

    def counts(self) -> DataFrame:
        c = self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("tokens"))
        i = self.inventory.agg(F.count_if(F.col("status") == "included").alias("included"), F.count_if(F.col("status") == "excluded").alias("excluded"))
        return i.crossJoin(c)  # one row each

    def digest(self) -> DataFrame:
        return self.records().agg(*multiset_digest(F.col("hash")))

    def metadata(self, repository: str, commit: str) -> DataFrame:
        """One row: repository, commit, builder, config (JSON), config_hash, build_id and the digest of the inventory."""
        own, listed = F.lit(self.config_hash), inventory_digest(self.inventory)
        named = [F.lit(repository).alias("repository"), F.lit(commit).alias("commit"), F.lit(BUILDER).alias("builder"), F.lit(canonical(self.config)).alias("config"), own.alias("config_hash"), build_id(F.lit(repository), F.lit(commit), own, BUILDER).alias("build_id")]
        return listed.select(*named, F.col("n_records").alias("n_entries"), F.col("hash_sum").alias("inventory_sum"), F.col("hash_xor").alias("inventory_xor"))


def inventory_digest(listed: DataFrame) -> DataFrame:
    return listed.agg(*multiset_digest(F.sha2(canonical_json("path", "mode", "oid", "status", "reason", "content_hash"), 256)))


def inventory(tree: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, path_base64, mode, oid, bytes, status, reason, content_hash, file_id for each entry of the tree."""
    c = classified(tree, max_bytes=max_bytes)
    included = F.col("reason").isNull()
    digest = F.when(included, content_hash(F.col("content")))
    own = c.select("path", base64(F.col("path")).alias("path_base64"), "mode", "oid", "bytes", F.when(included, "included").otherwise("excluded").alias("status"), "reason", digest.alias("content_hash"))
    return own.withColumn("file_id", file_id(F.col("path_base64"), F.col("content_hash")))


def build(tree: DataFrame, config: dict | None = None, previous: Build | None = None, tokenizer: str | None = None, keep: Callable[[DataFrame, str], DataFrame] = stored) -> Build:
    """``tree`` has path, mode, oid, bytes, content (text or bytes); ``tokenizer`` is the file that ``config`` counts by. Files that ``previous`` includes with the same path, oid and mode are not cut again.

    ``keep`` stores the cut of the others, which is the costly part and is read several times."""
    config = config or preset(tokenizer=tokenizer)
    if tokenizer and config["counter"] != chunking.vocabulary(tokenizer).name:
        raise ValueError("the tokenizer is not the one that the configuration names")
    own = config_hash(config)
    listed = inventory(tree, config["maxFileBytes"])
    included = classified(tree, max_bytes=config["maxFileBytes"]).where("reason IS NULL").withColumn("content", F.col("content").cast("string"))
    if previous and previous.config_hash != own:
        raise ValueError("a version is built on one of the same configuration")
    fresh = included
    if previous:
        kept = previous.inventory.where("status = 'included'").select("path", "oid", "mode")
        fresh = included.join(kept, ["path", "oid", "mode"], "left_anti")
    cut = keep(chunking.chunks(fresh, own, config["mode"], tokenizer), "cut")
    if previous:
        held = versions.reused(previous.chunks, included.join(kept, ["path", "oid", "mode"], "left_semi").select(file_id(base64(F.col("path")), content_hash(F.col("content"))).alias("file_id")), "file_id")
        cut = cut.unionByName(held)
    counts = cut.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    digest = content_hash(F.col("content"))
    files = included.select(
        file_id(base64(F.col("path")), digest).alias("id"), "path", F.col("oid").alias("blob_oid"), digest.alias("content_hash"), F.octet_length("content").cast("bigint").alias("byte_length"), F.col("content").alias("source_text"), language(F.col("path")).alias("language"), F.lit(own).alias("config_hash")
    )
    files = files.join(counts, files.id == counts.file_id, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint"))).drop("file_id")
    done = Build(config, listed, files, cut, tokenizer=tokenizer)
    if previous:
        done.changes = versions.change_classes(previous.inventory, listed)
        done.obsolete = versions.obsolete(previous.records(), done.records())
    return done
