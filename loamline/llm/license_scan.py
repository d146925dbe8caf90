"""Licence scans: sparse TF-IDF cosine of statements to templates, then inheritance from the nearest ancestor directory.

Every line of every file is a possible statement, and so is every paragraph (cut at blank lines, and at lines without terms), the leading
comment, and the whole text of a file named like a licence file: wrapped notices count as a whole. Terms are lower-cased runs of letters and digits. A template term weighs
``ln((N + 1) / (df + 1)) + 1`` by the number of files that hold it, counted over all files; terms of no template weigh like one that no file
holds. One of these is a statement of the template with the highest cosine (of equal ones the first by name) if that is at least
``least``. A file's own licence is that of its best statement. A file named like a licence file gives its licence to its directory, and a file
without one takes that of the nearest directory at or above its own.

Only those that can reach ``least`` are scored: each template's weightiest terms are taken until the rest of its vector is shorter than
``least`` of it, so by the Cauchy-Schwarz inequality one without any of them stays below. This drops no statement.

Only DataFrame functions are used. Templates and their term counts are on the driver (a few hundred terms). Directories are resolved
once each, from distinct directories, before files join them. Null texts have no statement. Every row counts as a file in the
frequencies of terms; rows of one path share the best statement of any of them. Very long lines are scored whole. A null path
has no directory and inherits nothing. Other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

TERM = r"[\p{L}\p{N}]+"
LICENCE_FILE = r"(?i)\A(licen[cs]e|copying|copyright|notice|unlicense)([._-].*)?\z"

#: Where the first line starts that is neither blank nor marked as a comment.
CODE_LINE = r"(?m)^(?![ \t\r]*(?://|/\*|\*|#|--|;|%|$))"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _template_terms(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


def telling_terms(weights: dict[str, float], least: float) -> set[str]:
    """The fewest weightiest terms without which a line's cosine to this template stays below ``least``."""
    whole, rest, out = sum(w * w for w in weights.values()), 0.0, set()
    rest = whole
    for term in sorted(weights, key=lambda t: (-weights[t], t)):
        if math.sqrt(max(0.0, rest) / whole) < least * (1 - 1e-9):
            break
        out.add(term)
        rest -= weights[term] ** 2
    return out


def _pieces(file: Column, low: Column) -> Column:
    """Lines, paragraphs of more than one line, the leading comment, and a licence file as a whole."""
    several = lambda parts: F.filter(parts, lambda x: F.contains(x, F.lit("\n")))
    bare = F.ltrim(low)
    head = F.when(F.startswith(bare, F.lit("/*")), F.substring_index(low, "*/", 1)).when(F.startswith(bare, F.lit("<!--")), F.substring_index(low, "-->", 1)).otherwise(F.get(F.split(low, CODE_LINE, 2), F.lit(0)))
    named = F.element_at(F.split(file, "/"), -1).rlike(LICENCE_FILE) & ~F.startswith(file, F.lit("\x00"))
    whole = F.when(named, F.array(low)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(low, "\n"), several(F.split(low, r"\n[ \t\r]*\n")), several(F.split(low, r"\n[^\p{L}\p{N}\n]*\n")), several(F.array(head)), several(whole))


def statements(files: DataFrame, templates: dict[str, str], path: str = "path", text: str = "text", least: float = 0.6) -> DataFrame:
    """file_ (the path, or for a null one a hash of the text), licence, cosine: the best statement of each file that has one."""
    spark = files.sparkSession
    counts = {name: _template_terms(t) for name, t in templates.items()}
    known = sorted(set().union(*counts.values()))
    own = files.select(F.coalesce(F.col(path), F.concat(F.lit("\x00"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).alias("file_"), F.col(text).alias("text_"))
    schema = "file_ string, licence string, cosine double"
    if not known:
        return spark.createDataFrame([], schema)
    held = own.select(F.explode(F.array_append(F.array_intersect(terms(F.coalesce("text_", F.lit(""))), F.array(*map(F.lit, known))), F.lit(""))).alias("term"))
    df = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = df.pop("", 0)  # each file has the empty term once
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in known}
    unknown = math.log(n + 1) + 1
    vectors = {name: {t: c * idf[t] for t, c in own_terms.items()} for name, own_terms in counts.items() if own_terms}
    telling = sorted(set().union(*(telling_terms(v, least) for v in vectors.values())))

    hint = F.lit(False)
    for t in telling:
        hint = hint | F.contains("low_", F.lit(t))
    lines = own.withColumn("low_", F.lower("text_")).where(hint).select("file_", F.posexplode(_pieces(F.col("file_"), F.col("low_"))).alias("line", "l_"))
    lines = lines.select("file_", "line", terms(F.col("l_")).alias("terms_")).where(F.arrays_overlap("terms_", F.array(*map(F.lit, telling))))
    lines = written(lines.withColumn("id_", F.monotonically_increasing_id()), "licence-lines")
    tf = lines.select("id_", F.explode("terms_").alias("term")).groupBy("id_", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = spark.createDataFrame([(t, idf[t]) for t in known], "term string, idf double")
    of_template = spark.createDataFrame([(t, name, w / math.sqrt(sum(x * x for x in v.values()))) for name, v in vectors.items() for t, w in v.items()], "term string, licence string, unit double")
    weighed = tf.join(weight, "term", "left").select("id_", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    length = weighed.groupBy("id_").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = weighed.join(of_template, "term").groupBy("id_", "licence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    scored = dot.join(length, "id_").select("id_", "licence", F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.join(lines.select("id_", "file_"), "id_").groupBy("file_", "licence").agg(F.max("cosine").alias("cosine"))
    best = best.groupBy("file_").agg(F.max_by("licence", F.struct("cosine", _descending("licence", vectors))).alias("licence"), F.max("cosine").alias("cosine"))
    return written(best, "licence-statements")


def _descending(name: str, among) -> Column:
    """A number that is larger for names that sort earlier."""
    out = F.lit(0)
    for k, x in enumerate(sorted(among, reverse=True)):
        out = F.when(F.col(name) == x, k).otherwise(out)
    return out


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_extract(path, r"\A((?s).*)/[^/]*\z", 1)


def scan(files: DataFrame, templates: dict[str, str], key: str = "doc_id", path: str = "path", text: str = "text", least: float = 0.6) -> DataFrame:
    """``key``, ``path``, own_licence, cosine, inherited_from (a directory), licence for each row of ``files``."""
    best = statements(files, templates, path, text, least)
    own = files.select(F.col(key).alias("key_"), F.col(path).alias("path_"), F.coalesce(F.col(path), F.concat(F.lit("\x00"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).alias("f_"), directory(F.col(path)).alias("dir_"))
    name = F.element_at(F.split("file_", "/"), -1)
    given = best.where(name.rlike(LICENCE_FILE) & ~F.startswith("file_", F.lit("\x00"))).withColumn("d_", directory(F.col("file_")))
    given = given.groupBy("d_").agg(F.max_by("licence", F.struct("cosine", _descending("licence", templates))).alias("given_"))
    parts = F.split("dir_", "/")
    up = own.select("dir_").where("dir_ IS NOT NULL").distinct().select(
        "dir_", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir_") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))).alias("up")
    )
    found = up.join(given, F.col("up.at") == F.col("d_")).groupBy("dir_").agg(F.max_by(F.struct(F.col("up.at").alias("at"), "given_"), "up.depth").alias("near"))
    found = written(found.select(F.col("dir_").alias("of_"), "near.at", "near.given_"), "licence-directories")
    out = own.join(best, F.col("f_") == F.col("file_"), "left").join(found, F.col("dir_") == F.col("of_"), "left")
    inherits = F.col("licence").isNull()
    return out.select(
        F.col("key_").alias(key), F.col("path_").alias("path"), F.col("licence").alias("own_licence"), "cosine", F.when(inherits, F.col("at")).alias("inherited_from"), F.coalesce("licence", "given_").alias("licence")
    )
