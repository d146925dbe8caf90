"""Rows in one order, packed greedily into bounded batches: exactly what a loop would make, without a loop over rows.

A batch takes rows as long as it has fewer than ``most_rows`` and its bytes (``each`` and the rows' sizes) stay within ``most_bytes``; a row that is
over the limit by itself is a batch of its own. So the batch that starts at a row ends at a row that follows from sums alone: the first whose end lies beyond the
start's sum and the limit. That link is found for all rows at once by sorting starts and limits together. The batches are the rows that
links reach from row 0; they are found by doubling: in round k every row knows the row 2**k links on, and the rows that are known to be
starts send it to theirs. The number of rounds is the logarithm of the number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.sources.tables import stored

#: Rows that one window sums.
BLOCK = 4096


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows``, written, with ``row_`` from 0 in ``order`` (ties in any order), by a range sort: no task has all rows."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    held = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id_", F.monotonically_increasing_id()), "numbered").withColumn("part_", F.shiftright("id_", 33))
    # A row for each partition of the sort.
    parts = held.groupBy("part_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(parts.select("part_", (F.col("first_") - before).alias("first_"))), "part_").withColumn("row_", F.col("id_") - F.col("first_")).drop("id_", "part_", "first_")


def summed(rows: DataFrame, value: Column, name: str, start: str = "row_") -> DataFrame:
    """``rows`` (numbered) with the sum of ``value`` over all earlier rows: sums within blocks of rows, and of the blocks before."""
    own = rows.withColumns({"v_": value, "block_": F.floor(F.col(start) / BLOCK)})
    blocks = own.groupBy("block_").agg(F.sum("v_").alias("s_"))
    sum_before = lambda over, v: F.coalesce(F.sum(v).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block_", sum_before(Window.orderBy("block_"), "s_").alias("b_"))
    return own.withColumn("w_", sum_before(Window.partitionBy("block_").orderBy(start), "v_")).join(blocks, "block_").withColumn(name, F.col("w_") + F.col("b_")).drop("v_", "block_", "w_", "b_")


def _links(rows: DataFrame, n: int, total: int, most_rows: int | None, room: int) -> DataFrame:
    """row, to: where the next batch starts if one starts at ``row`` (``n``: nowhere). ``rows`` has row_ and sum_ (bytes before it)."""
    spark = rows.sparkSession
    points = rows.select(F.col("sum_").alias("at"), F.lit(0).alias("kind"), F.col("row_").alias("point"), F.lit(None).cast("bigint").alias("row"))
    points = points.unionByName(spark.range(1).select(F.lit(total).cast("bigint").alias("at"), F.lit(0).alias("kind"), F.lit(n).cast("bigint").alias("point"), F.lit(None).cast("bigint").alias("row")))
    limits = rows.select((F.col("sum_") + room).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("point"), F.col("row_").alias("row"))
    # Rows come in the order of their sums, so the last point at or before a limit is the greatest so far.
    both = numbered(points.unionByName(limits), "at", "kind", "point").withColumn("block_", F.floor(F.col("row_") / BLOCK))
    blocks = both.groupBy("block_").agg(F.max("point").alias("m_"))
    earlier = blocks.select("block_", F.max("m_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)).alias("m_"))
    upto = F.max("point").over(Window.partitionBy("block_").orderBy("row_").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("p_", upto).join(earlier, "block_").where("kind = 1").select("row", F.greatest("p_", "m_", F.col("row") + 1).alias("to"))
    return found.withColumn("to", F.least("to", F.col("row") + most_rows)) if most_rows else found


def pack(rows: DataFrame, order: list[Column | str], size: str, most_rows: int | None = 500, most_bytes: int = 4_900_000, each: int = 32) -> DataFrame:
    """``rows``, all columns, with ``row_`` (place in ``order``) and ``batch`` (from 0).

    Null sizes count as 0. Rows that are equal in ``order`` come in any order, so it should tell rows apart. An empty table stays empty.
    """
    held = stored(summed(numbered(rows, *order), F.coalesce(F.col(size), F.lit(0)).cast("bigint"), "sum_"), "pack-rows")
    n, total = held.agg(F.count(F.lit(1)), F.coalesce(F.max(F.col("sum_") + F.coalesce(F.col(size), F.lit(0))), F.lit(0)).cast("bigint")).first()
    links = stored(_links(held.select("row_", "sum_"), n, total, most_rows, most_bytes - each), "pack-links")
    starts = held.sparkSession.range(min(n, 1)).select(F.col("id").alias("row"))
    while True:
        reached = starts.join(links, "row").where(F.col("to") < n).select(F.col("to").alias("row"))
        more = stored(starts.unionByName(reached).distinct(), "pack-starts")
        if links.where(f"row = 0 AND to < {n}").limit(1).count() == 0:  # 2**k links from the first row on all rows are behind
            break
        starts = more
        onward = links.select(F.col("row").alias("to"), F.col("to").alias("further"))
        links = stored(links.join(onward, "to", "left").select("row", F.coalesce("further", F.lit(n).cast("bigint")).alias("to")), "pack-links")
    flagged = held.join(more.withColumnRenamed("row", "row_").withColumn("start_", F.lit(1)), "row_", "left").withColumn("start_", F.coalesce("start_", F.lit(0)))
    return summed(flagged, F.col("start_"), "batch").withColumn("batch", F.col("batch") + F.col("start_") - 1).drop("start_", "sum_")


def parts(entries: DataFrame, order: list[Column | str], text: str, most_bytes: int = 1_000_000, single: int = 4_000_000) -> DataFrame:
    """part, n_entries, bytes, part_hash: entries (``text``) in order, in parts of at most ``most_bytes``. The hash is that of the entries' hashes in order.

    An entry of ``single`` bytes or more is an error. A part's entries are bounded by its bytes, so they meet in one task.
    """
    size = F.octet_length(F.col(text)).cast("bigint")
    sized = entries.select("*", F.when(size >= single, F.raise_error(F.lit("an entry is too large"))).otherwise(size).alias("size_"))
    packed = pack(sized, order, "size_", None, most_bytes, 0)
    hashes = F.sort_array(F.collect_list(F.struct("row_", F.sha2(F.col(text), 256).alias("h"))))
    found = packed.groupBy("batch").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("size_").alias("bytes"), hashes.alias("e_"))
    return found.select(F.col("batch").alias("part"), "n_entries", "bytes", F.sha2(F.concat_ws(",", F.transform("e_", lambda e: e["h"])), 256).alias("part_hash"))
