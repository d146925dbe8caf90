"""Order MinHash fingerprints: signatures that notice both which words a text has and in which order.

K-mers are runs of ``k`` words, numbered by occurrence so that repeats count. Each of the slots takes, of the numbered
k-mers whose hash falls to it, the ``keep`` with the smallest hashes, puts them back into text order and hashes the tuple.
The share of equal slots between two fingerprints estimates how alike the texts are in words and order. With ``fill``, a slot with fewer
k-mers goes on with the least of the slots after it, round from the last to the first, so that short texts are compared by order too.

Only DataFrame functions are used. A text of fewer than ``k`` words is one k-mer; one without words has only empty slots.
Slots empty in both texts do not count; two texts whose slots are all empty are alike (1.0).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a packed k-mer that hold its place: arrays, and so texts, have fewer words than 2 to this power. The other 33 are of its hash.
PLACE_BITS = 31
BLANKS = r"[\x20\x09-\x0D]+"


def fingerprint(text: Column, k: int = 3, slot_bits: int = 5, keep: int = 2, fill: bool = False) -> Column:
    """array<bigint> with one entry for each filled slot; the first ``slot_bits`` bits of an entry tell its slot. ``fill``: all slots, if there are words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))
    return _let(words, lambda w: _let(F.sort_array(_kmers(w, k)), lambda s: _let(_numbered(s), lambda a: _slots(a, slot_bits, keep, fill))))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(h: Column, place: Column) -> Column:
    """Leading bits of a hash and a place in one number, which sorts by hash, then place."""
    return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("bigint"))


def _hash(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _kmers(w: Column, k: int) -> Column:
    n = F.size(w)
    runs = F.slice(F.arrays_zip(*[F.slice(w, F.lit(j + 1), n) for j in range(k)]), F.lit(1), F.greatest(n - k + 1, F.lit(0)))
    short = F.array(_packed(F.xxhash64(F.array_join(w, " ")), F.lit(0)))
    return F.when((n > 0) & (n < k), short).otherwise(F.transform(runs, lambda x, i: _packed(F.xxhash64(x), i)))


def _numbered(s: Column) -> Column:
    """The sorted k-mers with the occurrence number mixed into the hashes of second and later occurrences, sorted again."""
    again = lambda x, j: (j > 0) & (_hash(F.get(s, j - 1)) == _hash(x))
    return _let(F.filter(s, again), lambda r: F.when(F.size(r) == 0, s).otherwise(F.sort_array(F.concat(F.filter(s, lambda x, j: ~again(x, j)), _renumbered(r)))))


def _renumbered(repeats: Column) -> Column:
    """Sorted second and later occurrences with their numbers (from 2) mixed in: a number is the distance from the head of the run of its hash."""
    head = lambda x, j: (j == 0) | (_hash(F.get(repeats, j - 1)) != _hash(x))
    heads = F.array_compact(F.transform(repeats, lambda x, j: F.when(head(x, j), j)))

    def run(at: Column, end: Column) -> Column:
        mixed = lambda x, i: _packed(F.xxhash64(_hash(x), i + 2), x.bitwiseAND(2**PLACE_BITS - 1))
        return F.transform(F.slice(repeats, at + 1, end - at), mixed)

    return _let(heads, lambda hs: F.flatten(F.transform(hs, lambda at, m: run(at, F.coalesce(F.get(hs, m + 1), F.size(repeats))))))


def _slot(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def _slots(a: Column, bits: int, keep: int, fill: bool) -> Column:
    """The leading bits of a hash tell its slot, so in sorted order each slot's smallest come first."""
    least = F.filter(a, lambda x, j: (j < keep) | (_slot(F.get(a, j - keep), bits) != _slot(x, bits)))

    def folded(own: Column) -> Column:
        in_text_order = F.sort_array(F.transform(own, lambda y: F.struct(y.bitwiseAND(2**PLACE_BITS - 1), _hash(y).alias("h"))))
        return F.shiftrightunsigned(F.xxhash64(F.transform(in_text_order, lambda y: y["h"])), bits)

    def tagged(slot: Column, of: Column) -> Column:
        return F.shiftleft(slot, 64 - bits).bitwiseOR(of)

    def entry(m: Column, x: Column, j: Column) -> Column:
        return tagged(_slot(x, bits), folded(F.filter(F.slice(m, j + 1, F.lit(keep)), lambda y: _slot(y, bits) == _slot(x, bits))))

    def entries(m: Column, ring: Column, x: Column, j: Column) -> Column:
        """Of the slot that starts at ``x`` and the empty ones before it: all go on from ``x``."""
        empty = F.pmod(_slot(x, bits) - _slot(F.get(ring, j + F.size(m) - 1), bits) - 1, F.lit(2**bits).cast("bigint"))
        of_slots = lambda f: F.transform(F.sequence(F.lit(0).cast("bigint"), empty), lambda i: tagged(F.pmod(_slot(x, bits) - i, F.lit(2**bits).cast("bigint")), f))
        return _let(folded(F.slice(ring, j + 1, F.least(F.size(m), F.lit(keep)))), of_slots)

    def heads(m: Column) -> Column:
        first = lambda x, j: (j == 0) | (_slot(F.get(m, j - 1), bits) != _slot(x, bits))
        if not fill:
            return F.array_compact(F.transform(m, lambda x, j: F.when(first(x, j), entry(m, x, j))))
        whole = lambda ring: F.flatten(F.array_compact(F.transform(m, lambda x, j: F.when(first(x, j), entries(m, ring, x, j)))))
        return _let(F.concat(m, m), whole)

    return _let(least, heads)


def likeness(a: Column, b: Column, slot_bits: int = 5) -> Column:
    """Share of slots that agree, of those that either text fills."""
    slots = lambda f: F.transform(f, lambda x: _slot(x, slot_bits))
    filled = F.size(F.array_union(slots(a), slots(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(prints: Column) -> Column:
    """The fingerprint as one string of hex numbers."""
    return F.array_join(F.transform(prints, lambda x: F.lower(F.hex(x))), ".")


def with_next(rows: DataFrame, key: str, *columns: str, groups_per_partition: int = 4) -> DataFrame:
    """``key``, ``columns`` and, as ``next_<column>``, those of the row next by (key, hash of columns); after the last comes the first.

    No task holds the whole order: rows are cut by key into ranges of about equal size (a few for each shuffle partition, whose bounds
    are all that the driver sees), and the first row of each range is sent to the range before it too. Null keys come first.
    A key that fills several ranges is cut by a hash of the columns, by which ties of all keys go (then by the columns).
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    groups = groups_per_partition * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(k, [i / groups for i in range(1, groups)], 20 * groups).alias("b")).first()["b"] or []
    bounds = sorted((b, -(2**63) + 2**64 * i // n) for b, n in Counter(found).items() for i in range(n))
    placed = rows.select(key, *columns, k.alias("k_"), F.xxhash64(columns[0]).alias("h_"))
    placed = placed.withColumn("g_", _upper_bound(bounds, F.col("k_"), F.col("h_")))
    first = {r["g_"]: tuple(r["first"]) for r in placed.groupBy("g_").agg(F.min(F.struct("k_", "h_")).alias("first")).collect()}
    if not first:
        return rows.select(key, *columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    order = sorted(first)
    before = [order[order.index(g) - 1] if g in first else -1 for g in range(len(bounds) + 1)]
    of_first = lambda i: F.get(_longs([first.get(g, (0, 0))[i] for g in range(len(bounds) + 1)]), F.col("g_"))
    is_first = (of_first(0) == F.col("k_")) & (of_first(1) == F.col("h_"))
    own, sent = F.struct(F.col("g_").alias("g"), F.lit(0).alias("sent")), F.struct(F.get(_longs(before), F.col("g_")).cast("int").alias("g"), F.lit(1).alias("sent"))
    dealt = placed.withColumn("to_", F.explode(F.when(is_first, F.array(own, sent)).otherwise(F.array(own))))
    within = Window.partitionBy("to_.g").orderBy("to_.sent", "k_", "h_", *columns)
    return dealt.select(key, *columns, *[F.lead(c).over(within).alias(f"next_{c}") for c in columns], F.col("to_.sent").alias("sent_")).where("sent_ = 0").drop("sent_")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _upper_bound(bounds: list[tuple[int, int]], k: Column, h: Column) -> Column:
    """How many of the sorted ``bounds`` are not above (``k``, ``h``), by halving."""
    if not bounds:
        return F.lit(0)
    held, low = _longs([b for b, _ in bounds]), _longs([x for _, x in bounds])

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & ((F.get(held, mid) < k) | ((F.get(held, mid) == k) & (F.get(low, mid) <= h)))
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), ends, step, lambda acc: acc["lo"])


def with_edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike the text's is to that and to the next document's.

    Edited: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document by ``key``.
    Null texts are empty. Equal texts have equal fingerprints. Repeated rows stay; ties of ``key`` go by a hash of the text. Other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n, q = F.length("t_"), F.floor(F.length("t_") / 4).cast("int")
    pairs = with_next(docs.select(key, t.alias("t_"), fingerprint(t, **options).alias("f_")), key, "t_", "f_")
    edited = pairs.select(key, n.cast("bigint").alias("n_chars"), "f_", "next_f_", F.concat(F.substring("t_", F.lit(1), n - q), F.substring("next_t_", F.lit(1), q)).alias("e_"))
    printed = edited.select(key, "n_chars", F.sha2("e_", 256).alias("edited_sha256"), "f_", "next_f_", fingerprint(F.col("e_"), **options).alias("ef_"))
    return printed.select(
        key, "n_chars", "edited_sha256", as_text(F.col("f_")).alias("fingerprint"), as_text(F.col("ef_")).alias("edited_fingerprint"),
        likeness(F.col("f_"), F.col("ef_")).alias("near_edited"), likeness(F.col("f_"), F.col("next_f_")).alias("near_next"),
    )
