"""Point look-ups: a table stored in order of a hash of its key, so that a batch of keys reads the few pages that can hold them.

The hash is stored as a column with a Bloom filter. Files cover ranges of hashes that do not overlap, row groups and pages likewise, so their least and greatest hashes tell
which to read; where a table is a list of segments, each of which covers all hashes, the Bloom filters tell the segments that lack a key. A hot key's rows lie together and may fill many pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stored hash of the key.
HASH = "hash_"
#: Leading bits of a hash that tell its range; so many ranges, at most, are given to a scan.
RANGE_BITS = 8


def write(df: DataFrame, at: str, key: str, group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """``df`` with the hash of ``key``, in order of it. Small row groups and pages, as a look-up reads whole ones. Ranges of (hash, all of a hot key's row) are alike in size."""
    if HASH in df.columns:
        raise ValueError(f"the table has a column {HASH} already")
    hashed = df.withColumn(HASH, F.xxhash64(key))
    # The second column deals the rows of one key to several tasks.
    dealt = hashed.repartitionByRange(HASH, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))])).sortWithinPartitions(HASH)
    dealt.write.option(f"parquet.bloom.filter.enabled#{HASH}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).parquet(at)


def covers(keys: DataFrame) -> list:
    """low, high: the hashes of a batch as at most 2^``RANGE_BITS`` ranges. A range of one key is a single hash, which Bloom filters can answer."""
    hashed = keys.groupBy(F.shiftright(HASH, 64 - RANGE_BITS)).agg(F.min(HASH).alias("low"), F.max(HASH).alias("high"))
    return hashed.select("low", "high").collect()


def stored(spark: SparkSession, at: str | list[str], keys: DataFrame) -> DataFrame:
    """The stored rows in the ranges of ``keys`` (with their hashes): all that can match, and little else."""
    within = [F.col(HASH) == r.low if r.low == r.high else F.col(HASH).between(r.low, r.high) for r in covers(keys)]
    return spark.read.parquet(*([at] if isinstance(at, str) else at)).where(reduce(lambda a, b: a | b, within, F.lit(False)))


def find(spark: SparkSession, at: str | list[str], keys: DataFrame, key: str) -> DataFrame:
    """Each distinct ``key`` of a batch with the columns of its rows in the table, nulls where it has none (``found`` is false). A null key is found nowhere; all rows of a
    repeated key are given. The batch may be large: its ranges prune the scan, a join finds the rows."""
    asked = keys.select(key).distinct().withColumn(HASH, F.xxhash64(key))
    rows = stored(spark, at, asked).withColumn("found", F.lit(True))
    joined = asked.join(rows, [HASH, key], "left").drop(HASH)
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))
