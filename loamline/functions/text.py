"""Text, path and line expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    "java": "java", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini",
}
#: White space of Unicode and the byte order mark.
SPACE = r"(?U)[\s\x{FEFF}]"


def language(path: Column) -> Column:
    """By what follows the last dot, or the whole path without one; ``text`` otherwise."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[F.lower(F.element_at(F.split(path, r"\."), -1))], F.lit("text"))


def lines(text: Column) -> Column:
    """Lines with their terminators; a last one without a terminator counts, an empty text has none."""
    return F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+\z)"), F.lit(1))


def line_count(text: Column) -> Column:
    """A newline at the end adds no line."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def newlines(data: Column) -> Column:
    """In bytes, wherever they were cut."""
    held = data.cast("string")
    return F.octet_length(held) - F.octet_length(F.replace(held, F.lit("\n"), F.lit("")))


def line_at_byte(text: Column, offset: Column) -> Column:
    """One more than the newlines before a byte offset."""
    return newlines(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int"))) + 1


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{SPACE}*\z")


def first_token(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?U)([^\s\x{FEFF}]+)", 1)
    return F.when(found != "", found)


def enrichment(path: Column, scope: Column | None = None, symbol: Column | None = None) -> Column:
    """Path, scope and symbol, those that there are, each on a line."""
    parts = [F.substring(path, 1, 240), *[F.substring(x, 1, 160) for x in (scope, symbol) if x is not None]]
    return F.concat(F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("\n"))


def excerpt(text: Column, size: int = 600) -> Column:
    return F.substring(text, 1, size)


def slug(text: Column, size: int = 24) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    cut = F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, size)
    return F.regexp_replace(cut, r"\A-+|-+\z", "")


def normalized_remote(raw: Column) -> Column:
    """host/path of a repository address, ``scheme://`` or ``user@host:path``; null for what is neither.

    Credentials, outer slashes and a final ``.git`` go; hosts are lower-case, and so are paths on github.com.
    """
    value = F.regexp_replace(raw, rf"\A{SPACE}+|{SPACE}+\z", "")
    url = r"(?i)\A(?:ssh|https?|git)://(?:[^@/?#]*@)?([^/?#]+)(/[^?#]*)?\z"
    scp = r"\A(?:[^@/:]+@)?([^/:]+):(.+)\z"
    is_url = F.contains(value, F.lit("://"))
    host = F.lower(F.when(is_url, F.regexp_extract(value, url, 1)).otherwise(F.regexp_extract(value, scp, 1)))
    path = F.when(is_url, F.regexp_extract(value, url, 2)).otherwise(F.regexp_extract(value, scp, 2))
    path = F.regexp_replace(F.regexp_replace(path, r"\A/+|/+\z", ""), r"\.git\z", "")
    path = F.when(host == "github.com", F.lower(path)).otherwise(path)
    bad = (host == "") | (path == "") | path.rlike(r"(\A|/)(\.{0,2})(/|\z)")
    return F.when(~bad, F.concat(host, F.lit("/"), path))


def citation(version: Column, path: Column, first: Column, last: Column, name: str = "corpus") -> Column:
    return F.format_string("%s@%s:%s:%d-%d", F.lit(name), version, path, first, last)
