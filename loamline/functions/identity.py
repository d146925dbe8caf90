"""Content-derived names: hashes of canonical JSON of known shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64(text: Column) -> Column:
    """Without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _json_array(*parts: Column) -> Column:
    """Of strings without characters that JSON escapes, or numbers."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def file_id(path_base64: Column, content: Column) -> Column:
    return F.concat(F.lit("f-"), F.sha2(_json_array(_quoted(path_base64), _quoted(content)), 256))


def chunk_id(file: Column, config: Column, start: Column, end: Column, ordinal: Column) -> Column:
    numbers = [x.cast("string") for x in (start, end, ordinal)]
    return F.concat(F.lit("c-"), F.sha2(_json_array(_quoted(file), _quoted(config), *numbers), 256))


def build_id(repository: Column, commit: Column, config: Column, builder: str) -> Column:
    return F.sha2(_json_array(_quoted(repository), _quoted(commit), _quoted(config), F.lit(f'"{builder}"')), 256)


def version_tag(commit: Column) -> Column:
    return F.concat(F.lit("ver-"), F.substring(F.sha2(commit, 256), 1, 40))


def release_alias(ref: Column) -> Column:
    return F.concat(F.lit("rel-"), F.substring(F.sha2(ref, 256), 1, 40))


def canonical_json(*columns: str) -> Column:
    """The named columns as JSON with sorted keys, nulls left out, and lower-case escapes."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    low = text
    for code in "ABCDEF":  # an odd number of backslashes before u makes an escape
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){code}", rf"$1\\u00$2{code.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), low).otherwise(text)


def multiset_digest(hash_hex: Column) -> list[Column]:
    """Count, sum and exclusive-or of the leading 60 bits of hashes: the same for the same multiset in any order, summed map-side."""
    number = F.conv(F.substring(hash_hex, 1, 15), 16, 10).cast("bigint")
    return [F.count(hash_hex).alias("n_records"), F.sum(number.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(number).alias("hash_xor")]


def valid_vector(v: Column, dimensions: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))
