"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree domain - language - source. The token budget goes down the tree by weights; a child that cannot spend its
share (its tokens times ``max_epochs``) hands the shortage to its siblings, by their weights, and only what a whole family
cannot spend goes to the siblings of an ancestor. A leaf takes whole epochs of its documents and, of the last epoch, the
prefix of that many tokens in an order seeded for that leaf's last epoch; the document at the cut is taken to its part.

The order is that of the first 60 bits of an MD5 of seed, epoch, key and text, so that rows without keys, or of one key, have places of their own. Only
rows alike in key and text share one: at the cut they take the same part each, so that together they stay within what is left.

Only DataFrame functions are used. No leaf is sorted in one task: sums over hash ranges find the range where the cut falls, range by range within it until
what is left of any leaf is few places, and only these are put in order. Weights are relative within a family; what has none gets weight 1, and
non-positive ones count as 0. Null domains, languages and sources are groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
ADDED = ("mix_domain", "mix_tokens", "mix_epochs", "mix_part", "mix_taken")
#: A place has so many bits; each round of ranges tells so many of them.
PLACE_BITS, RANGE_BITS = 60, 10
#: Places of a leaf that are put in order at once.
EDGE_ROWS = 1000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def spread(nodes: DataFrame, parents: list[str], budget: Column) -> DataFrame:
    """``nodes`` (with columns weight, capacity) plus ``budget``: the parent's budget, poured by weight up to each capacity.

    Sorted by capacity over weight, the children that are filled come first; the rest share what is left by weight.
    """
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("fill_").asc_nulls_last(), "child_").rowsBetween(Window.unboundedPreceding, -1)
    v = nodes.withColumn("pool_", budget).withColumn("w_", w).withColumn("fill_", F.when(F.col("w_") > 0, F.col("capacity") / F.col("w_")))
    v = v.withColumn("spent_", F.coalesce(F.sum(F.when(F.col("w_") > 0, F.col("capacity"))).over(order), F.lit(0)))
    v = v.withColumn("left_w_", F.sum("w_").over(family) - F.coalesce(F.sum("w_").over(order), F.lit(0.0)))
    v = v.withColumn("level_", F.when(F.col("w_") > 0, (F.col("pool_") - F.col("spent_")) / F.col("left_w_")))
    v = v.withColumn("full_", F.coalesce(F.col("fill_") <= F.col("level_"), F.lit(False)))
    # The first child that is not full has the level that all such share.
    v = v.withColumn("level_", F.min(F.when(~F.col("full_") & (F.col("w_") > 0), F.struct("fill_", "child_", "level_"))).over(family)["level_"])
    share = F.when(F.col("w_") <= 0, F.lit(0)).when(F.col("full_"), F.col("capacity")).otherwise(F.floor(F.greatest(F.lit(0.0), F.col("w_") * F.col("level_"))))
    return v.withColumn("budget", F.least(F.col("capacity"), share.cast("bigint"))).drop("pool_", "w_", "fill_", "spent_", "left_w_", "level_", "full_")


def leaf_budgets(leaves: DataFrame, weights: DataFrame | None, total: int | Column, max_epochs: int = 2) -> DataFrame:
    """domain, lang, source, tokens, budget for each leaf of ``leaves`` (domain, lang, source, tokens).

    ``weights`` has domain, lang, source, weight; null lang and source there give a domain's weight, a null source that of a
    language in its domain. A weight given twice counts as its largest.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    out = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        at = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        if weights is None:
            at = at.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.lit(True) if depth == 2 else F.col(LEVELS[depth + 1]).isNull()).where(F.col(level).isNotNull())
            own = own.groupBy(*[F.col(k).alias(f"{k}_w") for k in keys]).agg(F.max("weight").cast("double").alias("weight"))
            at = at.join(own, [F.col(k).eqNullSafe(F.col(f"{k}_w")) for k in keys], "left").drop(*[f"{k}_w" for k in keys])
            at = at.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        at = at.withColumn("child_", F.col(level))
        if depth == 0:
            out = spread(at.withColumn("root_", F.lit(0)), ["root_"], F.lit(total) if isinstance(total, int) else total).drop("root_")
        else:
            up = out.select(*[F.col(k).alias(f"{k}_u") for k in keys[:-1]], F.col("budget").alias("pool"))
            at = at.join(up, [F.col(k).eqNullSafe(F.col(f"{k}_u")) for k in keys[:-1]]).drop(*[f"{k}_u" for k in keys[:-1]])
            out = spread(at, keys[:-1], F.col("pool")).drop("pool")
        out = out.drop("child_", "weight")
    done = out.select(*[F.col(k).alias(f"{k}_o") for k in LEVELS], "budget")
    return leaves.join(done, [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in LEVELS]).select(*LEVELS, "tokens", "budget")


def _looked_up(rows: DataFrame, found: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``found`` for the same ``keys``, nulls equal."""
    right = found.select(*[F.col(k).alias(f"{k}_r") for k in keys], *[c for c in found.columns if c not in keys])
    return rows.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys], how).drop(*[f"{k}_r" for k in keys])


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 0.6, max_epochs: int = 2, seed: int = 7, domain: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen rows of ``docs``, all columns, with ``mix_domain``, ``mix_tokens`` (of the text), ``mix_epochs`` (whole epochs that take
    it), ``mix_part`` (tokens taken of it in the last epoch) and ``mix_taken`` (tokens taken in all). Rows taken in no epoch are left out.

    The budget is ``share`` of all tokens and is never passed. Null texts, and texts without words, cost nothing and come with their place in the
    leaf's order. Null keys count as empty ones. Columns named like the added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    domain = F.lit("all") if domain is None else domain
    named = dict(zip(LEVELS, (domain.cast("string"), F.col(lang).cast("string"), F.col(source).cast("string")), strict=True))
    n, held = token_count(F.col(text)), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    sized = written(docs.select(*[c.alias(k) for k, c in named.items()], F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), held.alias("held"), n.alias("n")), "mix-sizes")
    leaves = written(sized.groupBy(*LEVELS).agg(F.sum("n").cast("bigint").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    some = F.col("tokens") > 0
    plan = leaf_budgets(leaves, weights, int(total * share), max_epochs).select(
        *LEVELS, F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint").alias("whole"), F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).cast("bigint").alias("rest")
    )
    plan = written(plan, "mix-plan")

    # The place in the last epoch of the last document taken: range by range that in which the sum reaches ``rest``, then the document.
    ranged = _looked_up(sized, plan, LEVELS).where("rest > 0").withColumn("spot", _place(seed, F.col("whole"), F.col("key"), F.col("held")))
    cut = plan.where("rest > 0").select(*LEVELS, "rest", F.lit(0).cast("bigint").alias("range"), F.lit(0).cast("bigint").alias("base"))
    for told in range(RANGE_BITS, PLACE_BITS + 1, RANGE_BITS):
        above = F.shiftright("spot", PLACE_BITS - told + RANGE_BITS)
        inside = ranged.select(*LEVELS, "n", "spot", above.alias("range"))
        sums = _looked_up(inside, cut.drop("rest"), (*LEVELS, "range")).groupBy(*LEVELS, "base", F.shiftright("spot", PLACE_BITS - told).alias("range")).agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("places"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
        sums = _looked_up(sums.withColumn("upto", upto), plan.select(*LEVELS, "rest"), LEVELS).where("upto - n < rest AND rest <= upto")
        cut = written(sums.select(*LEVELS, "rest", "range", (F.col("upto") - F.col("n")).alias("base"), "places"), "mix-ranges")
        largest = cut.agg(F.max("places").alias("most")).first()["most"] or 0
        cut = cut.drop("places")
        if largest <= EDGE_ROWS:
            break
    edge = _looked_up(ranged.select(*LEVELS, "n", "spot", F.shiftright("spot", PLACE_BITS - told).alias("range")), cut, (*LEVELS, "range"))
    edge = edge.groupBy(*LEVELS, "rest", "base", "spot").agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("times"))
    run = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("spot"))
    ends = edge.withColumn("run", run).where("run - n < rest AND rest <= run")
    ends = ends.select(*LEVELS, F.col("spot").alias("last"), F.floor((F.col("rest") - F.col("run") + F.col("n")) / F.col("times")).cast("bigint").alias("last_part"))
    cuts = written(_looked_up(plan, ends, LEVELS, "left").select(*[F.col(k).alias(f"mix_{k}") for k in LEVELS], "whole", "last", "last_part"), "mix-cuts")

    own = [f"mix_{k}" for k in LEVELS]
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    out = docs.select(*[F.col(c).alias(x) for c, x in names.items()], *[c.alias(f"mix_{k}") for k, c in named.items()], n.alias("mix_tokens"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), held.alias("held"))
    out = _looked_up(out, cuts, tuple(own)).withColumn("spot", _place(seed, F.col("whole"), F.col("key"), F.col("held")))
    inside = F.coalesce(F.col("spot") <= F.col("last"), F.lit(False))
    part = F.when(~inside, 0).when(F.col("spot") == F.col("last"), F.least("mix_tokens", "last_part")).otherwise(F.col("mix_tokens")).cast("bigint")
    kept = out.where((F.col("whole") > 0) | inside)
    return kept.select(*[F.col(x).alias(c) for c, x in names.items()], "mix_domain", "mix_tokens", F.col("whole").alias("mix_epochs"), part.alias("mix_part"), (F.col("whole") * F.col("mix_tokens") + part).alias("mix_taken"))


def _place(seed: int, epoch: Column, key: Column, held: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key, held).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
