"""What blocks of texts tell each other: sorted 64-bit codes with small numbers, dealt by the codes' leading bits and answered in the same order.

A block is one row of packed arrays. For each order (a kind of code) it deals its distinct codes once, however often its texts have them, so a
hot code comes once from each block. A group is one order and one range of codes; the number of ranges follows the number of tokens,
so a group's size does not grow with the corpus. Answers go back by block, order and range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import written

DEALT = "block_ bigint, order_ int, bucket_ bigint, codes_ binary, x_ binary, y_ binary, z_ binary"
BROUGHT = "block_ bigint, order_ int, bucket_ bigint, x_ binary, y_ binary, z_ binary, total_ bigint, distinct_ bigint"
VALUES = ("x_", "y_", "z_")
#: Tokens for each range of codes, about; one group is in memory at once.
GROUP_TOKENS = 2_000_000


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, of which the leading ones are mostly zero; the size comes first."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(x: bytes, kind=np.uint64) -> np.ndarray:
    planes = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


def range_bits(spark: SparkSession, tokens: int) -> int:
    """Leading bits that tell a code's range."""
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // GROUP_TOKENS)
    return max(1, int(groups - 1).bit_length())


def dealt(block: int, bits: int, order: int, codes: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A block's sorted codes with up to three arrays of numbers, cut by the leading ``bits``."""
    bounds = np.append(np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(codes))
    some = np.flatnonzero(np.diff(bounds))
    cut = [slice(bounds[k], bounds[k + 1]) for k in some]
    n = len(some)
    columns = [[pack_sorted(codes[c]) for c in cut], *[[pack(v[c]) for c in cut] for v in values], *[[b""] * n for _ in VALUES[len(values) :]]]
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([order] * n, pa.int32()), pa.array(some, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], names=["block_", "order_", "bucket_", "codes_", *VALUES])


class Group:
    """The rows of one group by block: the codes of all, their order, where each code starts in it, and how many blocks have it."""

    def __init__(self, t: pa.Table):
        self.rows = t.sort_by("block_")
        self.order_ = t["order_"][0].as_py()
        codes = [unpack_sorted(x) for x in self.rows["codes_"].to_pylist()]
        self.bounds = np.cumsum([0, *map(len, codes)])
        codes = np.concatenate(codes)
        self.order = np.argsort(codes, kind="stable")
        codes = codes[self.order]
        self.head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.times = np.diff(np.append(self.head, len(codes)))

    def values(self, column: str, kind=np.uint64) -> np.ndarray:
        """Numbers of a column, by code."""
        return np.concatenate([unpack(x, kind) for x in self.rows[column].to_pylist()])[self.order]

    def sums(self, column: str) -> np.ndarray:
        return np.add.reduceat(self.values(column), self.head)

    def answer(self, *by_code: np.ndarray, total: int = 0, distinct: int = 0) -> pa.Table:
        """Each block's numbers, in the order of its codes; each of ``by_code`` has one number for every code of every block."""
        n, columns = self.rows.num_rows, {}
        for name, v in zip(VALUES, by_code, strict=False):
            own = np.empty_like(v)
            own[self.order] = v
            columns[name] = [pack(own[a:z]) for a, z in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        once = lambda x: pa.array([x] + [0] * (n - 1), pa.int64())
        return pa.table({**{c: self.rows[c] for c in ("block_", "order_", "bucket_")}, **{c: pa.array(columns.get(c, [b""] * n), pa.binary()) for c in VALUES}, "total_": once(total), "distinct_": once(distinct)})


def answered(rows: DataFrame, summed, name: str) -> DataFrame:
    """What each group makes of what was dealt, as a table."""
    return written(rows.groupBy("order_", "bucket_").applyInArrow(lambda t: summed(Group(t)), BROUGHT), name)


def beside(held: DataFrame, brought: DataFrame):
    """Each block with what it was brought."""
    return held.groupBy("block_").cogroup(brought.groupBy("block_"))


def found_by_order(brought: pa.Table, orders: int) -> list[list[np.ndarray]]:
    """What a block was brought: for each order its (up to three) arrays, in the order of its codes."""
    brought = brought.select(["order_", "bucket_", *VALUES]).sort_by([("order_", "ascending"), ("bucket_", "ascending")])
    of, found = brought["order_"].to_numpy(), []
    for k in range(orders):
        a, z = np.searchsorted(of, [k, k + 1])
        found.append([np.concatenate([np.zeros(0, np.uint64), *[unpack(x) for x in brought[c][a:z].to_pylist() if x]]) for c in VALUES])
    return found
