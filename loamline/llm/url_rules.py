"""URL allow and block rules by host suffixes and path prefixes, joined on short hash prefixes.

Each URL is expanded into the (host suffix, path prefix) expressions of those shapes that some rule has
(number of host labels, length of path). Expressions meet the rules in an equi-join on the first hex digits of
their SHA-256; the full digest then confirms. Of the rules that fit, the longest wins. URLs that no rule fits take no part in the join.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Repeated rows stay repeated; very long URLs are
cut at every shape like others. Other columns of either table are not read. No rules: every URL gets the default verdict. Letters other than A-Z are
compared as they are, in URLs and rules alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return _lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1))


def _lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """``key``, host, path, rule, verdict for each row of ``urls``.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains when the URL's path starts with its path;
    the longest (host and path together, then host) wins, and of equal rules ``block``. Rules with nulls are ignored.

    The shapes of rules are one array of small numbers in the plan; there are at most as many as a rule's host can have labels times a
    path can have lengths, however many rules or URLs there are.
    """
    rules = (
        rules.select(_lowered(F.col("host")).alias("host"), F.col("path"), F.col("verdict"))
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of the two verdicts, "block" is the larger text
        .select(
            _digest(F.col("host"), F.col("path")).alias("r_digest"),
            F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("r_fit"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_size"),
        )
    )
    shapes = rules.groupBy("labels").agg(F.array_sort(F.collect_set("path_size")).alias("sizes")).orderBy("labels").collect()
    parsed = urls.select(F.col(key).alias("u_key"), host_of(F.col(url)).alias("u_host"), path_of(F.col(url)).alias("u_path"), F.monotonically_increasing_id().alias("u_row"))
    named = lambda rule, verdict: [F.col("u_key").alias(key), F.col("u_host").alias("host"), F.col("u_path").alias("path"), rule.cast("string").alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict")]
    if not shapes:
        return parsed.select(*named(F.lit(None), F.lit(None).cast("string")))
    # Written, as the numbers of rows must be the same where best rules come back to them.
    parsed = written(parsed, "urls")
    texts = F.split(F.lit(";".join(f"{r['labels']}:{','.join(map(str, r['sizes']))}" for r in shapes)), ";")
    found = parsed.where("u_host <> ''").select("u_row", F.split("u_host", r"\.").alias("u_labels"), "u_path")
    found = found.select("*", F.explode(texts).alias("u_shape"))
    n, sizes = F.substring_index("u_shape", ":", 1).cast("int"), F.split(F.substring_index("u_shape", ":", -1), ",").cast("array<int>")
    found = found.where(n <= F.size("u_labels")).select("u_row", "u_path", F.array_join(F.slice("u_labels", F.size("u_labels") - n + 1, n), ".").alias("u_suffix"), F.filter(sizes, lambda m: m <= F.length("u_path")).alias("u_sizes"))
    digests = F.transform("u_sizes", lambda m: _digest(F.col("u_suffix"), F.substring(F.col("u_path"), F.lit(1), m)))
    asked = found.select("u_row", F.explode(digests).alias("u_digest")).withColumn("u_short", F.substring("u_digest", 1, prefix_digits))
    held = rules.select(F.substring("r_digest", 1, prefix_digits).alias("r_short"), "r_digest", "r_fit")
    met = asked.join(held, (F.col("u_short") == F.col("r_short")) & (F.col("u_digest") == F.col("r_digest")))
    best = met.groupBy(F.col("u_row").alias("b_row")).agg(F.max("r_fit").alias("best"))
    return parsed.join(best, F.col("u_row") == F.col("b_row"), "left").select(*named(F.col("best.rule"), F.col("best.verdict")))
