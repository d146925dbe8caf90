"""Versions as lists of segments: each holds the rows that it adds, and the names of the earlier rows that are gone.

A row is named by two hashes of all that it says, so equal rows are shared by all versions that have them, a changed row is one gone and one added, and
what a version writes follows what has changed. A version of ``MOST`` segments is followed by one that holds all its rows anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a version that is still built upon.
MOST = 8
KEYS = ["k1_", "k2_"]
GONE = "k1_ bigint, k2_ bigint, id string"


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the names of its rows. Nulls count: hashes pass over them, so which columns are null is hashed too."""
    columns = [c for c in df.columns if c not in KEYS]
    said = [F.array(*[F.col(c).isNull() for c in columns]), *map(F.col, columns)]
    return df.select(*columns, *[F.xxhash64(F.lit(n), *said).alias(k) for n, k in enumerate(KEYS)])


def live(spark: SparkSession, root: str, segments: list[dict[str, str]], table: str) -> DataFrame:
    """The rows, with their names, of a version: those of its segments (folders of tables, in order) that no later segment has as gone."""
    rows = [spark.read.parquet(f"{root}/{s[table]}").withColumn("segment_", F.lit(n)) for n, s in enumerate(segments)]
    all_ = reduce(DataFrame.unionByName, rows)
    return without(spark, root, segments, table, all_, KEYS).drop("segment_")


def without(spark: SparkSession, root: str, segments: list[dict[str, str]], table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with segment_) whose ``keys`` no later segment has as gone."""
    gone = [spark.read.schema(GONE).parquet(f"{root}/{s['gone-' + table]}").select(*[F.col(k).alias(f"gone_{k}") for k in keys], F.lit(n).alias("gone_by_")) for n, s in enumerate(segments) if n]
    if not gone:
        return rows
    hit = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"gone_{k}") for k in keys])
    return rows.join(reduce(DataFrame.unionByName, gone), hit & (F.col("gone_by_") > F.col("segment_")), "left_anti")


def delta(new: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """What a segment adds to ``old`` and what goes, so that ``new`` is live after it (both keyed). Without ``old`` all is added."""
    if old is None:
        return new, None
    return new.join(old.select(*KEYS), KEYS, "left_anti"), old.join(new.select(*KEYS), KEYS, "left_anti")


def names(gone: DataFrame) -> DataFrame:
    """What a segment says of rows that are gone."""
    return gone.select(*KEYS, (F.col("id") if "id" in gone.columns else F.lit(None)).cast("string").alias("id"))
