"""Helpers shared by the operators: table access, shared-folder tables, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set a session of one machine (tests) gets a new one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _run(spark: SparkSession, write) -> None:
    """Runs a job whose shuffle files go when it ends."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        write()
    finally:
        spark.conf.set(cleanup, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _run(spark, lambda: df.write.parquet(at))
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like ``written``, in as many buckets by ``column`` as there are shuffle partitions: what meets it by that column is shuffled, it is not."""
    spark = df.sparkSession
    n, called = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, column)
    _run(spark, lambda: dealt.write.bucketBy(n, column).option("path", f"{shared_dir(spark)}/{called}").format("parquet").saveAsTable(called))
    return spark.table(called)


#: Rows of one or two numbers that may be broadcast, some tens of MB; more are joined by shuffling both sides.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def doc_split(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_blocks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, at least one text each; only one run is taken out of the column at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = min(len(sizes), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)) + 1)
        yield slice(at, stop), texts_of(column[at:stop])
        at = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}
_STEP = {True: BASE, False: np.uint64(pow(int(BASE), -1, 1 << 64))}
#: A fixed 64-bit code for each byte.
_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, up: bool) -> np.ndarray:
    """The first ``n`` powers of BASE, or of its inverse."""
    if len(_powers[up]) < n:
        steps = np.full(1 << int(n - 1).bit_length(), _STEP[up])
        steps[:1] = 1
        _powers[up] = np.cumprod(steps)
    return _powers[up][:n]


class Spans:
    """Hashes of any span of a sequence of 64-bit numbers, from running sums; equal spans have equal hashes wherever they stand."""

    def __init__(self, items: np.ndarray):
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * powers(len(items), True), out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * powers(len(self.sums), False)[a] + (b - a).astype(np.uint64))


#: Text bytes hashed at once, to bound memory.
HASH_BYTES = 1 << 20


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start (one entry more than texts).

    Words are the runs of bytes outside 0x20 and 0x09-0x0D, which is also what ``bytes.split`` gives.
    """
    found, starts = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
    for part in blocks(texts, HASH_BYTES):
        hashes, first = _hashed(texts[part], lower)
        starts[part.start + 1 : part.stop + 1] = starts[part.start] + first[1:]
        found.append(hashes)
    return np.concatenate(found), starts


def blocks(texts: list[bytes], limit: int = 2 << 20) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes, at least one text each."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _hashed(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    whole = b"\n".join(texts)
    codes = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = _BLANK[codes]
    a = np.flatnonzero(blank[:-1] & ~blank[1:])
    b = np.flatnonzero(~blank[:-1] & blank[1:])
    starts = np.zeros(len(texts) + 1, np.int64)
    starts[1:] = np.searchsorted(a, np.cumsum([len(t) + 1 for t in texts]))
    return Spans(_BYTE_CODES[codes]).of(a, b), starts


def shingled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; callers keep to places inside one text."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out ^ words[k : len(words) - n + 1 + k]) + np.uint64(k + 1)
    return out


def shingle_sets(texts: list[bytes], n: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words, starts = hashed_words(texts, lower)
    hashes = shingled(words, n)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(hashes[a : b - n + 1]))
        elif b > a:
            out.append(shingled(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
