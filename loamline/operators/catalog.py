"""Repositories of a catalogue: which collections have a usable descriptor, and which repository a selector names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by which a selector may name a repository; ``short`` is its key without the host.
NAMES = ("name", "repo_key", "short", "collection")


def discovered(collections: DataFrame, descriptors: DataFrame, purpose: str, schema_version: int = 1) -> DataFrame:
    """collection, status, repo_key, name for collections (collection, purpose) of one purpose: ``ready`` with a descriptor (collection, repo_key,
    name, schema_version) that is whole and of the right schema, else ``partial``."""
    own = collections.where(F.col("purpose") == purpose).select("collection")
    whole = F.col("repo_key").isNotNull() & F.col("name").isNotNull() & (F.col("schema_version") == schema_version)
    joined = own.join(descriptors.select("collection", "repo_key", "name", "schema_version"), "collection", "left").withColumn("ok", F.coalesce(whole, F.lit(False)))
    kept = [F.when(F.col("ok"), F.col(c)).alias(c) for c in ("repo_key", "name")]
    return joined.select("collection", F.when(F.col("ok"), "ready").otherwise("partial").alias("status"), *kept)


def selected(repositories: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, matches, collection for each of ``selectors`` (selector): the repository with that name, key, key without host, or collection.

    ``collection`` is null unless just one matches. Names are joined by equality, each repository under its distinct names.
    """
    short = F.regexp_extract("repo_key", r"\A[^/]*/(.+)\z", 1)
    named = repositories.withColumn("short", F.nullif(short, F.lit("")))
    every = named.select("collection", F.explode(F.array_distinct(F.array_compact(F.array(*NAMES)))).alias("selector"))
    found = every.groupBy("selector").agg(F.count(F.lit(1)).alias("n"), F.min("collection").alias("only"))
    asked = selectors.select("selector").distinct().join(found, "selector", "left")
    return asked.select("selector", F.coalesce("n", F.lit(0)).cast("bigint").alias("matches"), F.when(F.col("n") == 1, F.col("only")).alias("collection"))
