"""Range hash trees: what two tables of (key, hash) do not have in common, read only where it is.

Keys are dealt to ranges by the leading hex digits of their SHA-256. A leaf's digest is the SHA-256 of its rows in the order of keys; a node's that of its
children's digests in order; so the root is an ordered digest of the whole table, made in as many rounds as digits and never in one task.
Two trees of one depth are compared from the root down, and only under nodes that differ. Rows are stored by range, so that the rest of a table is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators.versions import mismatches
from loamline.sources.tables import stored

#: Rows of a leaf, about, where the depth follows the size of the table.
LEAF_ROWS = 1024
ROWS = "id string, hash string, leaf string, top string"


def depth_for(n: int) -> int:
    """Digits of a leaf's range, so that a leaf of ``n`` rows in all has about ``LEAF_ROWS``."""
    depth = 2
    while n > LEAF_ROWS * 16**depth:
        depth += 1
    return depth


def top_of(depth: int) -> int:
    """Leading digits of the folders that rows are stored in: 16 to 4,096 folders."""
    return min(3, max(1, depth - 2))


def _range(key: Column, digits: int) -> Column:
    return F.substring(F.sha2(key, 256), 1, digits)


def tree(rows: DataFrame, depth: int, key: str = "id", hash_: str = "hash") -> DataFrame:
    """prefix ('' for the root), n, digest of every node that has rows. Null keys and hashes count as empty texts. An empty table has no node."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    lines = rows.select(_range(k, depth).alias("prefix"), F.concat(k, F.lit(":"), F.coalesce(F.col(hash_).cast("string"), F.lit(""))).alias("line"))
    joined = lambda sep, c: F.sha2(F.concat_ws(sep, F.sort_array(F.collect_list(c))), 256).alias("digest")
    level = stored(lines.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), joined("\n", "line")), "hash-leaves")
    found = level
    for digits in range(depth - 1, -1, -1):
        level = level.withColumn("child", F.concat("prefix", F.lit(":"), "digest")).groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sum("n").alias("n"), joined(",", "child"))
        found = found.unionByName(level)
    return stored(found, "hash-tree")


def differing(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """The leaves (prefix) in which two trees differ. Below a node that is the same in both nothing is compared."""
    open_ = None
    for digits in range(depth + 1):
        level = [t.where(F.length("prefix") == digits) for t in (a, b)]
        if open_ is not None:
            up = open_.withColumnRenamed("prefix", "up")
            level = [t.join(up, F.substring("prefix", 1, digits - 1) == F.col("up"), "left_semi") for t in level]
        both = level[0].select("prefix", "digest").join(level[1].select("prefix", F.col("digest").alias("other")), "prefix", "full_outer")
        open_ = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix")
    return open_


class Ranged:
    """A table of (key, hash) under a folder, stored by ranges, with its tree."""

    def __init__(self, spark: SparkSession, at: str, depth: int):
        self.spark, self.at, self.depth = spark, at, depth
        self.tree = spark.read.parquet(f"{at}/tree")

    @classmethod
    def write(cls, rows: DataFrame, at: str, depth: int, key: str = "id", hash_: str = "hash") -> Ranged:
        k = F.col(key).cast("string").alias("id")
        own = rows.select(k, F.col(hash_).cast("string").alias("hash"), _range(F.coalesce(k, F.lit("")), depth).alias("leaf")).withColumn("top", F.substring("leaf", 1, top_of(depth)))
        own.repartitionByRange("top", "leaf", "id").sortWithinPartitions("top", "leaf").write.partitionBy("top").parquet(f"{at}/rows")
        tree(rows.sparkSession.read.schema(ROWS).parquet(f"{at}/rows"), depth).write.parquet(f"{at}/tree")
        return cls(rows.sparkSession, at, depth)

    def part(self, leaves: DataFrame, tops: list[str]) -> DataFrame:
        rows = self.spark.read.schema(ROWS).parquet(f"{self.at}/rows")
        return rows.where(F.col("top").isin(tops)).join(leaves.withColumnRenamed("prefix", "leaf"), "leaf", "left_semi").select("id", "hash")

    def against(self, found: Ranged) -> DataFrame:
        """id, expected_hash, found_hash where the two differ; see ``versions.mismatches``."""
        if self.depth != found.depth:
            raise ValueError("trees of different depths do not compare")
        leaves = stored(differing(self.tree, found.tree, self.depth), "hash-leaves")
        tops = [r.top for r in leaves.select(F.substring("prefix", 1, top_of(self.depth)).alias("top")).distinct().collect()]  # 4,096 at most
        return mismatches(self.part(leaves, tops), found.part(leaves, tops))
