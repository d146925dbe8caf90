"""Exact reads: line ranges with context, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions.text import citation, line_count, lines


def read_lines(files: DataFrame, version: Column, first: Column, last: Column, context: int = 0, text: str = "content", path: str = "path") -> DataFrame:
    """path, start_line, end_line, total_lines, text, content_hash, citation for each file of which a line is in the range, which is cut to the file.

    An empty file gives lines 1 to 0 and no text.
    """
    if not 0 <= context <= 1000:
        raise ValueError("context is 0 to 1000 lines")
    total = line_count(F.col(text)).cast("bigint")
    a, b = F.greatest(F.lit(1), first - context).cast("bigint"), F.least("total_lines", last + context).cast("bigint")
    cut = files.select(path, F.col(text).alias("t_"), total.alias("total_lines"), first.alias("first_"), last.alias("last_"))
    cut = cut.where((first <= F.greatest("total_lines", F.lit(1))) & (first <= last) & (first >= 1)).select(path, "t_", "total_lines", a.alias("start_line"), b.alias("end_line"))
    body = F.array_join(F.slice(lines(F.col("t_")), F.col("start_line").cast("int"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("int")), "")
    return cut.select(path, "start_line", "end_line", "total_lines", body.alias("text"), F.sha2("t_", 256).alias("content_hash"), citation(version, F.col(path), F.col("start_line"), F.col("end_line")).alias("citation"))
