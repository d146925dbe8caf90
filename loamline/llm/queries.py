"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring, quality, toxicity
from .common import doc_split, table
from .decontaminate import leaks
from .jaccard_join import grouped
from .license_scan import scan
from .mixing import mix
from .order_minhash import with_edited_likeness
from .prefix_trie import prefix_trie
from .spelling import variants
from .substring_dedup import without_repeats
from .token_counts import count_tokens
from .url_rules import judge

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DOMAIN_WEIGHTS = [("d0", None, None, 4.0), ("d1", None, None, 2.0), ("d2", None, None, 1.0), ("d3", None, None, 1.0), ("d0", "en", None, 3.0), ("d1", "en", None, 3.0), ("d2", "en", None, 3.0), ("d3", "en", None, 3.0)]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), use=doc_split("doc_id", 5) != 0)
    rated = quality.scored(docs, model).drop("text")
    return rated.select("doc_id", (doc_split("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), width=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 3) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


LICENCES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


def path_of_document():
    """A place in a tree for each document: source / thousands / sixties / name. Every eighth is called LICENSE: it stands in the
    innermost directory, every 64th one above it, every 512th at the source's top."""
    i = F.col("doc_id")
    top, mid, low = F.col("source"), F.concat(F.lit("b"), F.floor(i / 4096)), F.concat(F.lit("c"), F.floor(i / 256))
    name = F.concat(F.lit("LICENSE."), i)
    return F.when(i % 512 == 0, F.concat_ws("/", top, name)).when(i % 64 == 0, F.concat_ws("/", top, mid, name)).when(i % 8 == 0, F.concat_ws("/", top, mid, low, name)).otherwise(F.concat_ws("/", top, mid, low, F.concat(i, F.lit(".txt"))))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", path_of_document().alias("path"), "text"), LICENCES)


OP3_SQL = r"""
WITH templates(licence, t) AS (VALUES %s),
files AS (SELECT doc_id, text, CASE WHEN doc_id %% 512 = 0 THEN concat_ws('/', source, name) WHEN doc_id %% 64 = 0 THEN concat_ws('/', source, mid, name) WHEN doc_id %% 8 = 0 THEN concat_ws('/', source, mid, low, name) ELSE concat_ws('/', source, mid, low, doc_id || '.txt') END AS path
  FROM (SELECT *, 'b' || doc_id // 4096 AS mid, 'c' || doc_id // 256 AS low, 'LICENSE.' || doc_id AS name FROM documents)),
tc AS (SELECT licence, term, count(*) AS c FROM (SELECT licence, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS term FROM templates) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(DISTINCT path) AS df FROM (SELECT path, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM files) WHERE term IN (SELECT term FROM tc) GROUP BY term),
idf AS (SELECT DISTINCT tc.term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM tc LEFT JOIN df USING (term), n),
unit AS (SELECT licence, term, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY licence)) AS u FROM tc JOIN idf USING (term)),
lines AS (SELECT path, unnest(string_split(lower(text), chr(10))) AS l, unnest(range(len(string_split(lower(text), chr(10))))) AS line FROM files),
tf AS (SELECT path, line, term, count(*) AS tf FROM (SELECT path, line, unnest(regexp_extract_all(l, '[\p{L}\p{N}]+')) AS term FROM lines) GROUP BY ALL),
w AS (SELECT path, line, tf.term, tf * coalesce(idf, ln(n + 1) + 1) AS w FROM tf LEFT JOIN idf USING (term), n),
len AS (SELECT path, line, sqrt(sum(w * w)) AS len FROM w GROUP BY ALL),
cosine AS (SELECT path, licence, max(round(dot / len, 9)) AS cosine FROM (SELECT path, line, licence, sum(w * u) AS dot FROM w JOIN unit USING (term) GROUP BY ALL) JOIN len USING (path, line) GROUP BY ALL),
own AS (SELECT path, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) AS k FROM cosine WHERE cosine >= 0.6) WHERE k = 1),
given AS (SELECT dir, licence FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, licence, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY cosine DESC, licence) AS k FROM own WHERE regexp_matches(path, '/LICENSE[.][^/]*$')) WHERE k = 1),
up AS (SELECT path, depth, array_to_string(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/')[1:depth], '/') AS dir FROM files, (VALUES (1), (2), (3)) d(depth) WHERE depth <= len(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'))),
near AS (SELECT path, dir, licence FROM (SELECT path, dir, licence, row_number() OVER (PARTITION BY path ORDER BY depth DESC) AS k FROM up JOIN given USING (dir)) WHERE k = 1)
SELECT doc_id, f.path, own.licence AS own_licence, cosine, CASE WHEN own.licence IS NULL THEN near.dir END AS inherited_from, coalesce(own.licence, near.licence) AS licence FROM files f LEFT JOIN own ON own.path = f.path LEFT JOIN near ON near.path = f.path
""" % ", ".join(f"('{k}', '{v}')" for k, v in LICENCES.items())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS k, w FROM d),
wins AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM p),
late AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(gone.k) AS n_removed, string_agg(CASE WHEN gone.k IS NULL THEN word END, ' ' ORDER BY words.k) AS t FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited_likeness(table(spark, sf_dir, "documents"), fill=True)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, weights(spark), domain=domain_of("source")).select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epochs", "mix_part", "mix_taken")


def domain_of(source: str):
    """Four domains of sources, for want of a column that has them."""
    digest = F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary"))
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(4)).cast("string"))


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAIN_WEIGHTS, "domain string, lang string, source string, weight double")


def _spread_sql(name: str, up: str, level: str, keys: str, weight: str, pool: str) -> str:
    """SQL of one level of budgets: children by capacity over weight, those that are filled first; the rest share by weight."""
    family = keys.rpartition(", ")[0] or "1"
    above = f"JOIN {up} u ON " + " AND ".join(f"u.{k} IS NOT DISTINCT FROM c.{k}" for k in keys.split(", ")[:-1]) if up else ""
    return f"""{name}_c AS (SELECT {keys}, sum(capacity)::BIGINT AS capacity FROM nodes GROUP BY {keys}),
{name}_w AS (SELECT {", ".join(f"c.{k}" for k in keys.split(", "))}, c.capacity, {pool} AS pool, greatest(coalesce({weight}, 1.0), 0.0)::DOUBLE AS w FROM {name}_c c {above}),
{name}_f AS (SELECT *, CASE WHEN w > 0 THEN capacity / w END AS fill FROM {name}_w),
{name}_s AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN capacity END) OVER o, 0)::BIGINT AS spent, sum(w) OVER (PARTITION BY {family}) - coalesce(sum(w) OVER o, 0.0) AS left_w FROM {name}_f WINDOW o AS (PARTITION BY {family} ORDER BY fill NULLS LAST, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_l AS (SELECT *, CASE WHEN w > 0 THEN (pool - spent) / left_w END AS level FROM {name}_s),
{name}_p AS (SELECT *, coalesce(fill <= level, false) AS filled FROM {name}_l),
{name} AS (SELECT {keys}, least(capacity, CASE WHEN w <= 0 THEN 0 WHEN filled THEN capacity ELSE floor(greatest(0.0, w * first_value(level) OVER (PARTITION BY {family} ORDER BY (NOT filled AND w > 0) DESC, fill NULLS LAST, {level} NULLS FIRST)))::BIGINT END)::BIGINT AS budget FROM {name}_p)"""


OP6_SQL = rf"""
WITH weights(domain, lang, source, weight) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in w) + ")" for w in DOMAIN_WEIGHTS)}),
d AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, 'd' || (('0x' || md5(coalesce(source, ''))[1:8])::BIGINT % 4) AS domain, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n, coalesce(doc_id::VARCHAR, '') AS k, md5(coalesce(text, '')) AS held FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * 0.6::DOUBLE)::BIGINT AS t FROM leaves),
nodes AS (SELECT *, tokens * 2 AS capacity FROM leaves),
{_spread_sql("b1", "", "domain", "domain", "(SELECT max(weight) FROM weights x WHERE x.domain = c.domain AND x.lang IS NULL)", "(SELECT t FROM total)")},
{_spread_sql("b2", "b1", "lang", "domain, lang", "(SELECT max(weight) FROM weights x WHERE x.domain = c.domain AND x.lang = c.lang AND x.source IS NULL)", "u.budget")},
{_spread_sql("b3", "b2", "source", "domain, lang, source", "(SELECT max(weight) FROM weights x WHERE x.domain = c.domain AND x.lang = c.lang AND x.source = c.source)", "u.budget")},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves l JOIN b3 ON l.domain = b3.domain AND l.lang IS NOT DISTINCT FROM b3.lang AND l.source IS NOT DISTINCT FROM b3.source),
placed AS (SELECT d.*, whole, rest, ('0x' || md5('7:' || whole || ':' || k || ':' || held)[1:15])::BIGINT AS spot FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto, sum(n) OVER (PARTITION BY domain, lang, source, spot)::BIGINT AS here, count(*) OVER (PARTITION BY domain, lang, source, spot) AS times FROM placed),
cut AS (SELECT *, max(CASE WHEN rest > 0 AND upto - here < rest AND rest <= upto THEN spot END) OVER (PARTITION BY domain, lang, source) AS last FROM run),
part AS (SELECT *, CASE WHEN last IS NULL OR spot > last THEN 0 WHEN spot = last THEN least(n, (rest - upto + here) // times) ELSE n END AS part FROM cut)
SELECT doc_id, lang, source, domain AS mix_domain, n AS mix_tokens, whole::BIGINT AS mix_epochs, part::BIGINT AS mix_part, (whole * n + part)::BIGINT AS mix_taken FROM part WHERE whole > 0 OR coalesce(spot <= last, false)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = lm_scoring.score_rows(docs, doc_split("doc_id", 7) != 2, F.lit(True))
    return rated.select("doc_id", (doc_split("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS irn, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
iw AS (SELECT *, least(len(w), 5) AS n FROM i WHERE len(w) > 0),
isets AS (SELECT DISTINCT irn, item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT irn, item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM iw)),
widths AS (SELECT DISTINCT n FROM iw),
dsets AS (SELECT DISTINCT rn, doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT rn, doc_id, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, widths)),
sizes AS (SELECT irn, count(*) AS n_shingles FROM isets GROUP BY irn),
pairs AS (SELECT rn, doc_id, irn, item_id, count(*) AS n_shared FROM dsets JOIN isets USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM pairs JOIN sizes USING (irn) WHERE n_shared * 10 >= n_shingles * 8
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP10_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r, row_number() OVER () AS rn FROM pages),
parts AS (SELECT page_id, rn, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT p.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY rn ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS best
  FROM parts p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE best = 1
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 in SQL: the table of its 256 steps as a list, and the sum of a string of code points below 2,048.
CRC_SQL = """steps(i, v, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS crc_steps FROM steps WHERE k = 8)"""


def _crc_sql(s: str) -> str:
    data = f"flatten(list_transform(list_filter(string_split({s}, ''), lambda x: x <> ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, crc_steps[1 + (xor(a, b) & 255)])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS p, ({_crc_sql("conv_id::VARCHAR")}) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS own, pos, m, w FROM c JOIN t ON t.conv_id = c.p WHERE pos <= h UNION ALL SELECT c.conv_id, 1, pos, m, w FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, list(m ORDER BY own, pos) AS ms, list(w ORDER BY own, pos) AS ws FROM r GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(ms, []) AS ms, coalesce(ws, []) AS ws FROM c LEFT JOIN s USING (conv_id)),
x AS (SELECT conv_id, d, md5(array_to_string(ms[1:d], ',')) AS name, CASE WHEN d > 0 THEN md5(array_to_string(ms[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ms) AS ends FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM a)),
n AS (SELECT name, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM x GROUP BY name, d),
k AS (SELECT up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.name),
z AS (SELECT x.name, x.d, sum((m.n_convs - 1) * m.w) AS saved, count_if(m.n_children = 0) AS leaves FROM m JOIN x ON x.conv_id = m.conv_id AND x.d <= m.d GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256 FROM m JOIN z ON z.name = m.name AND z.d = m.d LEFT JOIN m u ON u.name = m.up
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=doc_split("doc_id", 5) != 0)
    rated = toxicity.scored(docs, model).drop("text")
    return rated.select("doc_id", (doc_split("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT k, run, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT run, n, {_crc_sql("k || ':' || run")} AS h FROM c, crc),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT near.word, min(other) AS form, any_value(top) AS form_n FROM near JOIN best ON best.word = near.word AND near.n = top JOIN w ON w.word = near.word WHERE top >= 2 * w.n GROUP BY near.word),
chain(word, root) AS (SELECT word, form FROM form UNION SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN last USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_order_minhash": op5_order_minhash,
    "op6_mix_sources": op6_mix_sources,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op3_license_scan": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_url_filters": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
