"""Which entries of a tree belong to the corpus, and why the others do not: the first rule that fits gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 1024 * 1024
MAX_RECORD_BYTES = 4_800_000
#: Directories of dependencies and build output, endings of binary and of generated files.
DIRECTORIES = r"(\A|/)(node_modules|vendor|vendored|dist|build|target|coverage|\.git|\.next)(/|\z)"
BINARY = r"(?i)\.(png|jpe?g|gif|ico|pdf|zip|gz|jar|class|woff2?|mp[34]|exe|dll|so|dylib|wasm)\z"
GENERATED = r"\.(min\.(js|css)|map)\z"
POINTER = "version https://git-lfs.github.com/spec/v1"


def name_reason(path: Column) -> Column:
    return F.when(path.rlike(DIRECTORIES), "dependency-or-build-output").when(path.rlike(BINARY), "binary-extension").when(path.rlike(GENERATED), "generated-output")


def content_reason(content: Column, is_binary: bool) -> Column:
    text = content.cast("string") if is_binary else content
    zero = F.contains(content, F.lit(bytearray(1))) if is_binary else F.contains(content, F.lit("\x00"))
    broken = ~F.is_valid_utf8(text) if is_binary else F.lit(False)
    pointer = F.startswith(text, F.lit(POINTER + "\n")) | F.startswith(text, F.lit(POINTER + "\r\n"))
    return F.when(zero, "binary-content").when(broken, "invalid-utf8-content").when(pointer, "lfs-pointer").when(F.octet_length(text) > MAX_RECORD_BYTES, "serialized-source-too-large")


def classified(tree: DataFrame, path: str = "path", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``tree`` (path, mode, bytes, content) plus ``reason``, null for what is included. A null path is not valid UTF-8."""
    p = F.col(path)
    by_entry = (
        F.when(p.isNull(), "invalid-utf8-path").when(F.col("mode") == "160000", "submodule").when(F.col("bytes") > max_bytes, "oversized").when(F.col("mode") == "120000", "symlink")
    )
    return tree.withColumn("reason", F.coalesce(by_entry, name_reason(p), content_reason(F.col("content"), tree.schema["content"].dataType.simpleString() == "binary")))
