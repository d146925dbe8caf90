"""Line tables and the units that Markdown and configuration files fall into, as windows over the lines of each file.

Only lengths and marks of lines are shuffled, not their text. A file's lines are one window group; files are bounded by
``classify.MAX_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import SPACE, is_blank, lines

FENCE = rf"\A{SPACE}*(```|~~~)"
HEADING = r"\A#{1,6}(?U)[\s\x{FEFF}]"
SETTING = rf"\A{SPACE}*(\[|[\w.-]+{SPACE}*[:=])"


def line_table(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """``key``, line (from 0), size in bytes, is_fence, is_heading, is_blank, is_setting for each line of each file."""
    each = files.select(key, F.posexplode(lines(F.col(text))).alias("line", "l"))
    return each.select(key, "line", F.octet_length("l").cast("bigint").alias("size"), F.col("l").rlike(FENCE).alias("is_fence"), F.col("l").rlike(HEADING).alias("is_heading"), is_blank(F.col("l")).alias("is_blank"), F.col("l").rlike(SETTING).alias("is_setting"))


def units(table: DataFrame, markdown: bool, key: str = "path") -> DataFrame:
    """``key``, unit, start_byte, end_byte, start_line, end_line (from 1).

    In Markdown a heading or blank line outside a fence starts a unit; elsewhere a section or setting line does.
    """
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1
    starts = (~fenced & (F.col("is_heading") | F.col("is_blank"))) if markdown else F.col("is_setting")
    placed = table.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("starts", (F.col("line") > 0) & starts)
    numbered = placed.withColumn("unit", F.sum(F.col("starts").cast("bigint")).over(upto))
    return numbered.groupBy(key, "unit").agg(F.min("at").alias("start_byte"), F.max(F.col("at") + F.col("size")).alias("end_byte"), (F.min("line") + 1).cast("bigint").alias("start_line"), (F.max("line") + 1).cast("bigint").alias("end_line"))
