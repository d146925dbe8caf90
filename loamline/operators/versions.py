"""What changed between two versions of a corpus, as joins on keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_classes(old: DataFrame, new: DataFrame, key: str = "path", same: tuple[str, ...] = ("oid", "mode", "status")) -> DataFrame:
    """``key`` and change (added, modified, deleted, unchanged) over the full outer join of two inventories."""
    a = old.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in same])
    b = new.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in same])
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "deleted").when(alike, "unchanged").otherwise("modified")
    return a.join(b, F.col("old_key") == F.col("new_key"), "full_outer").select(F.coalesce("new_key", "old_key").alias(key), change.alias("change"))


def obsolete(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``."""
    return old.join(new.select(key), key, "left_anti")


def reused(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``old`` whose keys all agree with a row of ``new``."""
    return old.join(new.select(*keys), list(keys), "left_semi")


def changed(old: DataFrame, new: DataFrame, key: str = "id", hash_: str = "hash") -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has with another hash."""
    before = old.select(F.col(key).alias("old_key"), F.col(hash_).alias("old_hash"))
    return new.join(before, F.col(key) == F.col("old_key"), "left").where(~F.col(hash_).eqNullSafe(F.col("old_hash"))).drop("old_key", "old_hash")


def mismatches(expected: DataFrame, found: DataFrame, key: str = "id", hash_: str = "hash") -> DataFrame:
    """Keys of which one side lacks the other's row or hash; empty when both hold the same records."""
    a = expected.select(F.col(key).alias("a_key"), F.col(hash_).alias("expected_hash"))
    b = found.select(F.col(key).alias("b_key"), F.col(hash_).alias("found_hash"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    return both.where(~F.col("expected_hash").eqNullSafe(F.col("found_hash"))).select(F.coalesce("a_key", "b_key").alias(key), "expected_hash", "found_hash")


#: Beginnings of names whose rest is hex, by the byte that stands for them; 255 is any other text.
_BEGINNINGS = ("", "ver-", "rel-")


def _packed(text: Column) -> Column:
    """A name in about half the bytes, for shuffles: hex digits as bytes after one for what stands before them. Equal only for equal names; null for null."""
    packed = F.concat(F.lit(b"\x00"), F.unhex(text))
    for n, begin in enumerate(_BEGINNINGS[1:], 1):
        packed = F.when(F.startswith(text, F.lit(begin)), F.concat(F.lit(bytes([n])), F.unhex(F.substring(text, len(begin) + 1, 1 << 20)))).otherwise(packed)
    hexed = text.rlike(rf"\A(?:{'|'.join(_BEGINNINGS[1:])})?[0-9a-f]{{2,128}}\z") & (F.length(text) % 2 == 0)
    return F.when(hexed, packed).otherwise(F.concat(F.lit(b"\xff"), F.encode(text, "UTF-8")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 1 << 20)
    text = F.decode(rest, "UTF-8")
    for n, begin in enumerate(_BEGINNINGS):
        text = F.when(F.substring(packed, 1, 1) == F.lit(bytes([n])), F.concat(F.lit(begin), F.lower(F.hex(rest)))).otherwise(text)
    return text


def release_status(names: DataFrame, published: DataFrame, aliases: DataFrame) -> DataFrame:
    """ref, commit, tag, status of names (ref, commit, alias): ``pending`` until the commit is published (commit, tag), ``out-of-sync`` while
    its alias (alias, target) is not there or points to another tag, else ``available``. What is shuffled is packed, and what is published only once."""
    packed = lambda df, *columns: df.select(*[c for c in df.columns if c == "ref"], *[_packed(F.col(c)).alias(c) for c in columns])
    known = packed(published, "commit", "tag").repartition("commit").distinct()
    joined = packed(names, "commit", "alias").join(known, "commit", "left").join(packed(aliases, "alias", "target"), "alias", "left")
    status = F.when(F.col("tag").isNull(), "pending").when(~F.col("target").eqNullSafe(F.col("tag")), "out-of-sync").otherwise("available")
    return joined.select("ref", _unpacked(F.col("commit")).alias("commit"), _unpacked(F.col("tag")).alias("tag"), status.alias("status"))


def matching(published: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector and the rows of ``published`` (commit, tag, ...) that it names: a tag, a commit, or 7 to 64 lower-case hex digits that start one.

    Both sides meet by equal tags or commits, or by equal leading seven digits of commits. A row is shuffled under those of its names only that some selector can be: hex commits
    under their digits, tags only if there is a selector that is not hex or the tag is hex.
    """
    hex_ = lambda c: c.rlike(r"\A[0-9a-f]{7,64}\z")
    selector, digits = F.col("selector"), F.substring("commit", 1, 7)
    asked = selectors.select("selector").distinct().select("selector", F.when(hex_(selector), F.substring("selector", 1, 7)).otherwise(selector).alias("key_"))
    others = selectors.where(~hex_(selector)).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    whole = F.when(others & ~hex_(F.col("commit")), F.col("commit"))
    tag = F.when(others | hex_(F.col("tag")), F.col("tag"))
    keys = F.array_distinct(F.array_compact(F.array(F.when(hex_(digits), digits), whole, tag)))
    both = published.withColumn("key_", F.explode(keys)).join(asked, "key_")
    return both.where((F.col("key_") == selector) | F.startswith("commit", "selector")).drop("key_").select("selector", *published.columns)
