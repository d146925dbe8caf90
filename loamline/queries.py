"""The registered queries over whole tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import identity, text
from loamline.operators import catalog, checks, chunking, classify, embedding, hash_tree, lookup, packing, reading, search, units, versions
from loamline.plans.build import BUILDER, config_hash, inventory, preset
from loamline.plans import segments
from loamline.sources.tables import shared_dir, stored, table, there, tree
from loamline.streaming import mutations

QUERY = "thing the ontion was retion"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL of the trees that ``sources.tables.tree`` makes of documents.
_PATH = """concat_ws('/', source, CASE WHEN doc_id % 50 = 7 THEN 'vendor' WHEN doc_id % 50 = 19 THEN 'build' ELSE 'src' END,
  doc_id || '.' || ['ts','md','json','yaml','java','txt','mdx','ini','js','png','min.js','css.map'][(doc_id % 12 + 1)::INT])"""
_LANG = """CASE lower(list_extract(string_split(path, '.'), -1)) WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript'
  WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'toml' THEN 'toml' WHEN 'ini' THEN 'ini' ELSE 'text' END"""


def _tree_sql(name: str, missing: int | None, edited: bool) -> str:
    kept = "TRUE" if missing is None else f"doc_id % 10 <> {missing}"
    content = "CASE WHEN doc_id % 10 = 2 THEN coalesce(text, '') || chr(10) || 'revised' || chr(10) ELSE coalesce(text, '') END" if edited else "coalesce(text, '')"
    return f"""{name}_raw AS (SELECT doc_id, {_PATH} AS path, CASE WHEN doc_id % 97 = 5 THEN '120000' WHEN doc_id % 97 = 6 THEN '160000' ELSE '100644' END AS mode, {content} AS content FROM documents WHERE {kept}),
{name} AS (SELECT *, sha256(content) AS oid, octet_length(encode(content))::BIGINT AS bytes, CASE WHEN mode = '160000' THEN 'submodule' WHEN octet_length(encode(content)) > 1048576 THEN 'oversized' WHEN mode = '120000' THEN 'symlink'
  WHEN regexp_matches(path, '(^|/)(node_modules|vendor|vendored|dist|build|target|coverage|\\.git|\\.next)(/|$)') THEN 'dependency-or-build-output'
  WHEN regexp_matches(path, '\\.(png|jpe?g|gif|ico|pdf|zip|gz|jar|class|woff2?|mp[34]|exe|dll|so|dylib|wasm)$') THEN 'binary-extension'
  WHEN regexp_matches(path, '\\.(min\\.(js|css)|map)$') THEN 'generated-output' END AS reason, {_LANG} AS language,
  'f-' || sha256('["' || base64(encode(path)) || '","' || sha256(content) || '"]') AS file_id FROM {name}_raw)""".replace("\\\\", "\\")


#: All documents as one version, and the two versions that are compared.
_ALL, _A, _B = _tree_sql("a", None, False), _tree_sql("a", 0, False), _tree_sql("b", 1, True)


def _included(spark: SparkSession, sf_dir: str, version: str | None = None) -> DataFrame:
    return classify.classified(tree(spark, sf_dir, version)).where("reason IS NULL")


@query(f"WITH {_ALL} SELECT language, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM a GROUP BY language")
def language_counts(spark, sf_dir):
    return tree(spark, sf_dir).groupBy(text.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query(f"WITH {_ALL} SELECT coalesce(reason, 'included') AS reason, count(*) AS files FROM a GROUP BY ALL")
def exclusion_reasons(spark, sf_dir):
    return classify.classified(tree(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {_ALL} SELECT doc_id, path, coalesce(reason, '') AS reason FROM a WHERE reason IS NOT NULL")
def excluded_entries(spark, sf_dir):
    return classify.classified(tree(spark, sf_dir)).where("reason IS NOT NULL").select("doc_id", "path", "reason")


@query(f"""WITH {_ALL} SELECT count(*) FILTER (reason IS NULL) AS included, count(*) FILTER (reason IS NOT NULL) AS excluded, (sum(bytes) FILTER (reason IS NULL))::BIGINT AS bytes,
  (sum(len(content) - len(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END) FILTER (reason IS NULL))::BIGINT AS lines FROM a""")
def inventory_totals(spark, sf_dir):
    c = classify.classified(tree(spark, sf_dir)).withColumn("ok", F.col("reason").isNull())
    return c.agg(F.count_if("ok").alias("included"), F.count_if(~F.col("ok")).alias("excluded"), F.sum(F.when(F.col("ok"), F.col("bytes"))).alias("bytes"), F.sum(F.when(F.col("ok"), text.line_count(F.col("content")))).cast("bigint").alias("lines"))


@query(f"WITH {_ALL} SELECT path, oid AS content_hash, file_id FROM a WHERE reason IS NULL")
def file_ids(spark, sf_dir):
    return inventory(tree(spark, sf_dir)).where("status = 'included'").select("path", "content_hash", "file_id")


@query(f"""WITH {_ALL} SELECT path, (len(content) - len(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines,
  len(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+$'))::BIGINT AS listed FROM a WHERE reason IS NULL""".replace("\\\\", "\\"))
def line_counts(spark, sf_dir):
    return _included(spark, sf_dir).select("path", text.line_count(F.col("content")).cast("bigint").alias("lines"), F.size(text.lines(F.col("content"))).cast("bigint").alias("listed"))


_LINES = r"""l0 AS (SELECT path, unnest(regexp_extract_all(content, '[^\n]*\n|[^\n]+$')) AS l, unnest(range(len(regexp_extract_all(content, '[^\n]*\n|[^\n]+$')))) AS line FROM a WHERE reason IS NULL AND language {which}),
l1 AS (SELECT path, line, octet_length(encode(l))::BIGINT AS size, regexp_matches(l, '^\s*(```|~~~)') AS fence, regexp_matches(l, '^#{{1,6}}\s') OR trim(l, chr(10) || chr(13) || chr(9) || ' ') = '' AS head, regexp_matches(l, '^\s*(\[|[\w.-]+\s*[:=])') AS setting FROM l0),
l2 AS (SELECT *, coalesce(sum(size) OVER w, 0) AS pos, coalesce(sum(fence::INT) OVER w, 0) % 2 = 1 AS fenced FROM l1 WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, sum((line > 0 AND {starts})::INT) OVER (PARTITION BY path ORDER BY line) AS unit FROM l2)
SELECT path, unit::BIGINT AS unit, min(pos)::BIGINT AS start_byte, max(pos + size)::BIGINT AS end_byte, (min(line) + 1)::BIGINT AS start_line, (max(line) + 1)::BIGINT AS end_line FROM l3 GROUP BY path, unit"""


@query(f"WITH {_ALL}, " + _LINES.format(which="= 'markdown'", starts="NOT fenced AND head"))
def markdown_units(spark, sf_dir):
    files = _included(spark, sf_dir).where(text.language(F.col("path")) == "markdown")
    return units.units(units.line_table(files), markdown=True)


@query(f"WITH {_ALL}, " + _LINES.format(which="IN ('json', 'yaml', 'toml', 'ini')", starts="setting"))
def config_units(spark, sf_dir):
    files = _included(spark, sf_dir).where(text.language(F.col("path")).isin("json", "yaml", "toml", "ini"))
    return units.units(units.line_table(files), markdown=False)


@query()
def chunk_records(spark, sf_dir):
    """Whole chunker; its folds have no SQL and are tested against coverage and budget."""
    c = chunking.chunks(_included(spark, sf_dir), config_hash(preset()))
    return c.select("id", "file_id", "path", "ordinal", "start_byte", "end_byte", "start_line", "end_line", "chunk_kind", "symbol", "token_count", F.sha2("search_text", 256).alias("search_hash"))


@query()
def chunk_rollup(spark, sf_dir):
    c = chunking.chunks(_included(spark, sf_dir), config_hash(preset()))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])
    return c.groupBy("file_id", "path").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.max("end_byte").alias("covered"), F.sha2(F.concat_ws(",", ids), 256).alias("ids_hash"))


@query()
def build_violations(spark, sf_dir):
    """The integrity checks over a build of all documents in which some records are broken on purpose."""
    inc = _included(spark, sf_dir)
    own = config_hash(preset())
    c = stored(chunking.chunks(inc, own), "chunks")
    digest = identity.content_hash(F.col("content"))
    f = inc.select(identity.file_id(identity.base64(F.col("path")), digest).alias("id"), "path", digest.alias("content_hash"), F.octet_length("content").cast("bigint").alias("byte_length"), F.col("content").alias("source_text"), F.lit(own).alias("config_hash"))
    f = f.join(c.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_count")), F.col("id") == F.col("file_id")).drop("file_id")
    f = stored(f, "files")  # as a version keeps them; five checks read them
    odd = F.substring("file_id", 3, 1)
    broken = c.where(~((odd == "0") & (F.col("ordinal") == 0))).withColumn("token_count", F.when(odd == "1", F.lit(9999)).otherwise(F.col("token_count"))).withColumn("end_line", F.when(odd == "2", F.col("end_line") + 1).otherwise(F.col("end_line")))
    return checks.violations(f, broken.unionByName(c.where(odd == "3")), inventory(tree(spark, sf_dir)), own)


_UNIT = """u AS (SELECT doc_id, file_id, bytes, k AS ordinal, (bytes * k / 4)::BIGINT AS s0 FROM a, (VALUES (0), (1), (2), (3)) t(k) WHERE reason IS NULL),
c AS (SELECT doc_id, file_id, bytes, ordinal, bytes * ordinal // 4 AS start_byte, bytes * (ordinal + 1) // 4 AS end_byte, file_id || '#' || ordinal AS id FROM u WHERE NOT (doc_id % 13 = 4 AND ordinal = 2) AND NOT (doc_id % 17 = 5 AND ordinal = 3))"""


def _quarters(spark, sf_dir):
    """Files in four ranges, some of which are left out: for coverage, duplicates and parents."""
    inc = inventory(tree(spark, sf_dir)).where("status = 'included'")
    docs = inc.join(tree(spark, sf_dir).select("doc_id", "path"), "path").select("doc_id", "file_id", "bytes", F.explode(F.array(*map(F.lit, range(4))).cast("array<bigint>")).alias("ordinal"))
    part = lambda k: F.floor(F.col("bytes") * k / 4)
    c = docs.select("doc_id", "file_id", "bytes", "ordinal", part(F.col("ordinal")).alias("start_byte"), part(F.col("ordinal") + 1).alias("end_byte"), F.concat_ws("#", "file_id", "ordinal").alias("id"))
    return c.where(~((F.col("doc_id") % 13 == 4) & (F.col("ordinal") == 2)) & ~((F.col("doc_id") % 17 == 5) & (F.col("ordinal") == 3)))


@query(f"""WITH {_ALL}, {_UNIT}, o AS (SELECT *, coalesce(max(end_byte) OVER (PARTITION BY file_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM c)
SELECT 'coverage-gap' AS check_name, id, covered::VARCHAR AS detail FROM o WHERE start_byte > covered
UNION ALL SELECT 'coverage-short', file_id, max(end_byte)::VARCHAR FROM c GROUP BY file_id, bytes HAVING max(end_byte) <> bytes""")
def coverage_violations(spark, sf_dir):
    c = _quarters(spark, sf_dir)
    files = c.select(F.col("file_id").alias("id"), F.col("bytes").alias("byte_length")).distinct()
    return checks.gaps(c, files)


@query(f"WITH {_ALL}, {_UNIT}, twice AS (SELECT id FROM c UNION ALL SELECT id FROM c WHERE doc_id % 7 = 3) SELECT 'duplicate-id' AS check_name, id, count(*)::VARCHAR AS detail FROM twice GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    c = _quarters(spark, sf_dir)
    return checks.duplicates(c.select("id").unionByName(c.where("doc_id % 7 = 3").select("id")))


@query(f"WITH {_ALL}, {_UNIT} SELECT 'orphan-chunk' AS check_name, id, file_id AS detail FROM c WHERE doc_id % 11 = 6")
def orphan_chunks(spark, sf_dir):
    c = _quarters(spark, sf_dir)
    return checks.orphans(c, c.where("doc_id % 11 <> 6").select(F.col("file_id").alias("id")).distinct())


@query(f"""WITH {_A}, {_B} SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted'
  WHEN a.oid = b.oid AND a.mode = b.mode AND (a.reason IS NULL) = (b.reason IS NULL) THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def change_classes(spark, sf_dir):
    return versions.change_classes(inventory(tree(spark, sf_dir, "A")), inventory(tree(spark, sf_dir, "B")))


@query(f"WITH {_A}, {_B} SELECT DISTINCT file_id FROM a WHERE reason IS NULL AND file_id NOT IN (SELECT file_id FROM b WHERE reason IS NULL)")
def obsolete_ids(spark, sf_dir):
    old, new = (inventory(tree(spark, sf_dir, v)).where("status = 'included'").select("file_id") for v in "AB")
    return versions.obsolete(old.distinct(), new, "file_id")


@query(f"WITH {_A}, {_B} SELECT b.path, b.oid FROM b JOIN a USING (path, oid, mode) WHERE a.reason IS NULL AND b.reason IS NULL")
def reused_records(spark, sf_dir):
    old, new = (inventory(tree(spark, sf_dir, v)).where("status = 'included'") for v in "AB")
    return versions.reused(new, old, "path", "oid", "mode").select("path", "oid")


@query(f"WITH {_A}, {_B} SELECT b.path, b.oid FROM b LEFT JOIN a USING (path) WHERE b.oid IS DISTINCT FROM a.oid")
def changed_records(spark, sf_dir):
    return versions.changed(tree(spark, sf_dir, "A").select("path", "oid"), tree(spark, sf_dir, "B").select("path", "oid"), "path", "oid")


@query(f"WITH {_A}, {_B} SELECT coalesce(a.path, b.path) AS path, a.oid AS expected_hash, b.oid AS found_hash FROM a FULL JOIN b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def corpus_mismatch(spark, sf_dir):
    return versions.mismatches(tree(spark, sf_dir, "A"), tree(spark, sf_dir, "B"), "path", "oid")


def _level_sql(digits: int) -> str:
    return f"l{digits} AS (SELECT prefix[1:{digits}] AS prefix, sum(n) AS n, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM l{digits + 1} GROUP BY prefix[1:{digits}])"


@query(f"""WITH {_ALL}, l2 AS (SELECT sha256(path)[1:2] AS prefix, count(*) AS n, sha256(string_agg(path || ':' || oid, chr(10) ORDER BY path || ':' || oid)) AS digest FROM a GROUP BY sha256(path)[1:2]), {_level_sql(1)}, {_level_sql(0)}
  SELECT prefix, n::BIGINT AS n, digest FROM l2 UNION ALL SELECT prefix, n::BIGINT, digest FROM l1 UNION ALL SELECT prefix, n::BIGINT, digest FROM l0""")
def range_tree(spark, sf_dir):
    """The ordered digest of all records as a tree over ranges of keys."""
    return hash_tree.tree(tree(spark, sf_dir).select(F.col("path").alias("id"), F.col("oid").alias("hash")), 2)


@query(f"WITH {_A}, {_B} SELECT coalesce(a.path, b.path) AS id, a.oid AS expected_hash, b.oid AS found_hash FROM a FULL JOIN b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid")
def range_mismatch(spark, sf_dir):
    """Records that differ, read from the ranges in which two trees differ."""
    root = f"{shared_dir(spark)}/ranged-{uuid.uuid4().hex}"
    a, b = (hash_tree.Ranged.write(tree(spark, sf_dir, v), f"{root}/{v}", 3, "path", "oid") for v in "AB")
    return a.against(b)


@query(f"""WITH {_ALL} SELECT language, count(*) AS n_records, sum(('0x' || oid[1:15])::BIGINT)::HUGEINT::VARCHAR AS hash_sum, bit_xor(('0x' || oid[1:15])::BIGINT) AS hash_xor FROM a GROUP BY language""")
def records_digest(spark, sf_dir):
    return tree(spark, sf_dir).groupBy(text.language(F.col("path")).alias("language")).agg(*identity.multiset_digest(F.col("oid")))


_TERM = r"[\p{L}\p{N}_]+(?:[.''][\p{L}\p{N}_]+)*"
_POSTINGS = f"t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_TERM}') AS w, lang FROM documents), e AS (SELECT id, len(w) AS length, unnest(w) AS term FROM t)"


@query(f"WITH {_POSTINGS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM e GROUP BY term")
def document_frequency(spark, sf_dir):
    p = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_POSTINGS} SELECT term, id, length::BIGINT AS length, count(*) AS tf FROM e GROUP BY ALL")
def term_postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


# Documents that the index holds but its postings do not, for want of terms, count in n and in the mean length.
def _bm25_sql(keep: str, rows: str = _POSTINGS) -> str:
    words = ", ".join(f"('{w}')" for w in sorted(set(QUERY.split())))
    return f"""WITH {rows}, q(term) AS (VALUES {words}), s AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM t),
tf AS (SELECT id, length, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
r AS (SELECT tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))), 6) AS score FROM tf JOIN df USING (term), s, t WHERE t.id = tf.id AND {keep} GROUP BY tf.id)
SELECT id, score FROM r ORDER BY score DESC, id LIMIT 10"""


@query(_bm25_sql("TRUE"))
def bm25_topk(spark, sf_dir):
    return _indexed(spark, sf_dir).ranked(QUERY, 10)


#: Folders of indexes by session and table.
_INDEXES: dict[tuple[str, str], search.Index] = {}


def _indexed(spark, sf_dir):
    """An index of all documents, written once in a session and read by the terms of each query."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES or not there(spark, f"{_INDEXES[key].at[0]}/totals/_SUCCESS"):
        _INDEXES[key] = search.Index.write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id", "text", attributes=("lang",))
    return _INDEXES[key]


@query(_bm25_sql("lang = 'en'"))
def bm25_filtered(spark, sf_dir):
    return _indexed(spark, sf_dir).ranked(QUERY, 10, where={"lang": "en"})


def _two_segments(spark, sf_dir):
    """Version A as a segment, and what B changes as another: folders, and B's files by what they say."""
    root, segments_ = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}", [{"files": "a/files", "index": "a/index"}, {"files": "b/files", "gone-files": "b/gone", "index": "b/index"}]
    files = lambda v: segments.keyed(_included(spark, sf_dir, v).select(F.col("path").alias("id"), "oid", "bytes", F.col("content").alias("search_text")))
    files("A").write.parquet(f"{root}/a/files")
    held = segments.live(spark, root, segments_[:1], "files")
    added, gone = segments.delta(files("B"), held)
    added.write.parquet(f"{root}/b/files")
    gone = stored(gone, "gone")  # for its names, and for what it takes off the index
    segments.names(gone).write.parquet(f"{root}/b/gone")
    return root, segments_, gone


@query(f"WITH {_B} SELECT path AS id, oid, bytes FROM b WHERE reason IS NULL")
def segment_rows(spark, sf_dir):
    """Version B read from a segment of A and one of the changes."""
    root, segments_, _ = _two_segments(spark, sf_dir)
    return segments.live(spark, root, segments_, "files").select("id", "oid", "bytes")


@query(_bm25_sql("TRUE", f"{_B}, t AS (SELECT path AS id, regexp_extract_all(lower(content), '{_TERM}') AS w FROM b WHERE reason IS NULL), e AS (SELECT id, len(w) AS length, unnest(w) AS term FROM t)"))
def segment_search(spark, sf_dir):
    """Version B searched in the index of A and that of the changes: scores are those of an index of B."""
    root, segments_, gone = _two_segments(spark, sf_dir)
    for s, less in zip(segments_, (None, gone)):
        search.Index.write(spark.read.parquet(f"{root}/{s['files']}"), f"{root}/{s['index']}", less=less)
    index = search.Index(spark, [f"{root}/{s['index']}" for s in segments_], lambda hits: segments.without(spark, root, segments_, "files", hits, ["id"]))
    return index.ranked(QUERY, 10)


@query("SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ("trash", "licensed")))
def match_any_term(spark, sf_dir):
    return search.matching_any(table(spark, sf_dir, "documents"), "Trash licensed", "doc_id", "text")


def _read_sql(first: int, last: int, context: int) -> str:
    return rf"""WITH {_ALL}, x AS (SELECT path, content, oid, regexp_extract_all(content, '[^\n]*\n|[^\n]+$') AS l FROM a WHERE reason IS NULL),
y AS (SELECT *, len(l)::BIGINT AS total_lines, greatest(1, {first} - {context})::BIGINT AS start_line, least(len(l), {last} + {context})::BIGINT AS end_line FROM x WHERE {first} <= greatest(len(l), 1))
SELECT path, start_line, end_line, total_lines, array_to_string(l[start_line:end_line], '') AS text, oid AS content_hash, 'corpus@A:' || path || ':' || start_line || '-' || end_line AS citation FROM y"""


@query(f"""WITH {_ALL}, k AS (SELECT path FROM a WHERE doc_id % 20 = 0 UNION SELECT 'absent/' || path FROM a WHERE doc_id % 20 = 0)
SELECT k.path, a.path IS NOT NULL AS found, a.mode, a.oid, a.bytes FROM k LEFT JOIN a ON k.path = a.path""")
def point_lookups(spark, sf_dir):
    """The entries of a batch of paths (of every id divisible by 20, and as many that are not there) in the whole tree."""
    at, whole = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}", tree(spark, sf_dir)
    lookup.write(whole.select("path", "mode", "oid", "bytes"), at, "path")
    own = whole.where("doc_id % 20 = 0").select("path")
    return lookup.find(spark, at, own.unionByName(own.select(F.concat(F.lit("absent/"), "path").alias("path"))), "path").select("path", "found", "mode", "oid", "bytes")


@query(_read_sql(2, 3, 0))
def read_range(spark, sf_dir):
    return reading.read_lines(_included(spark, sf_dir), F.lit("A"), F.lit(2), F.lit(3))


@query(_read_sql(4, 4, 2))
def read_context(spark, sf_dir):
    return reading.read_lines(_included(spark, sf_dir), F.lit("A"), F.lit(4), F.lit(4), context=2)


@query(r"""WITH r AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), h AS (SELECT page_id, lower(regexp_extract(u, '^https?://([^/]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/]*(.*)$', 1), '^/+|/+$', '', 'g'), '\.git$', '') AS p FROM r)
SELECT page_id, CASE WHEN host <> '' AND p <> '' THEN host || '/' || p END AS remote, rtrim(ltrim(substr(regexp_replace(lower(host), '[^a-z0-9]+', '-', 'g'), 1, 24), '-'), '-') AS slug FROM h""")
def url_normalize(spark, sf_dir):
    u = F.regexp_replace("url", r"[?#].*\z", "")
    return table(spark, sf_dir, "pages").select("page_id", text.normalized_remote(u).alias("remote"), text.slug(F.regexp_extract(u, r"\Ahttps?://([^/]*)", 1)).alias("slug"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x) OR isinf(x)), true)) AS valid FROM embeddings GROUP BY label")
def embedding_valid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(identity.valid_vector(F.col("embedding"), 64)).alias("valid"))


@query(f"WITH {_A}, {_B}, c AS (SELECT DISTINCT sha256(language || chr(0) || content) AS h FROM a WHERE reason IS NULL) SELECT DISTINCT sha256(language || chr(0) || content) AS input_hash FROM b WHERE reason IS NULL AND sha256(language || chr(0) || content) NOT IN (SELECT h FROM c)")
def embedding_cache_misses(spark, sf_dir):
    """Inputs of version B that a cache filled from A lacks."""
    own = lambda v: _included(spark, sf_dir, v).select(embedding.input_hash(text.language(F.col("path")), F.col("content")).alias("input_hash"))
    return embedding.misses(own("B"), own("A"))


@query("""SELECT conv_id, turn, (row_number() OVER w - 1)::BIGINT AS ordinal, coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte,
  (sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS end_byte FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_offsets(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("size"))
    return turns.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"), (end - F.col("size")).alias("start_byte"), end.alias("end_byte"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_ref_state(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return mutations.latest(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(ORACLES["latest_ref_state"])
def streamed_ref_state(spark, sf_dir):
    """The same table, kept by a stream that reads the log batch by batch."""
    schema = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value").schema
    return mutations.follow(spark, f"{sf_dir}/events.parque[t]", schema, "user_id", ("ts", "event_id"), mutations.new_folder(shared_dir(spark))).select("user_id", "event_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return mutations.windowed(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH p AS (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS oid FROM orders WHERE o_orderstatus = 'F'), al AS (SELECT DISTINCT 'rel-' || sha256('refs/tags/o' || l_orderkey)[1:40] AS name FROM lineitem WHERE l_linenumber = 2)
SELECT 'refs/tags/o' || o.o_orderkey AS ref, CASE WHEN p.oid IS NULL THEN 'pending' WHEN al.name IS NULL THEN 'out-of-sync' ELSE 'available' END AS status, 'ver-' || sha256(sha256(o.o_orderkey::VARCHAR))[1:40] AS tag
FROM orders o LEFT JOIN p ON p.o_orderkey = o.o_orderkey LEFT JOIN al ON al.name = 'rel-' || sha256('refs/tags/o' || o.o_orderkey)[1:40]""")
def release_status(spark, sf_dir):
    """Orders as names, finished ones as published commits, those with a second line as names that have an alias."""
    commit, ref = F.sha2(F.col("o_orderkey").cast("string"), 256), F.concat(F.lit("refs/tags/o"), F.col("o_orderkey"))
    orders = table(spark, sf_dir, "orders")
    names = orders.select(ref.alias("ref"), commit.alias("commit"), identity.release_alias(ref).alias("alias"))
    published = orders.where("o_orderstatus = 'F'").select(commit.alias("commit"), identity.version_tag(commit).alias("tag"))
    second = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select("l_orderkey").distinct()
    aliases = second.select(identity.release_alias(F.concat(F.lit("refs/tags/o"), F.col("l_orderkey"))).alias("alias"), identity.version_tag(F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("target"))
    return versions.release_status(names, published, aliases).select("ref", "status", identity.version_tag(F.col("commit")).alias("tag"))


@query("""WITH v AS (SELECT sha256(o_orderkey::VARCHAR) AS oid FROM orders), s AS (SELECT o_custkey, sha256(min(o_orderkey)::VARCHAR)[1:7] AS prefix FROM orders GROUP BY o_custkey)
SELECT o_custkey, prefix, count(*) AS matches, min(oid) AS oid FROM s JOIN v ON v.oid[1:7] = s.prefix GROUP BY ALL""")
def resolve_prefix(spark, sf_dir):
    """Commit prefixes of seven digits, each met with all commits by equality of their leading digits."""
    oid = lambda c: F.sha2(c.cast("string"), 256)
    orders = table(spark, sf_dir, "orders")
    commits = orders.select(oid(F.col("o_orderkey")).alias("commit")).withColumn("tag", identity.version_tag(F.col("commit")))
    asked = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select("o_custkey", F.substring(oid(F.col("k")), 1, 7).alias("selector"))
    found = versions.matching(commits, asked.select("selector")).groupBy("selector").agg(F.count(F.lit(1)).alias("matches"), F.min("commit").alias("oid"))
    return asked.join(found, "selector").select("o_custkey", F.col("selector").alias("prefix"), "matches", "oid")


# Pages as repositories of a catalogue: some of another purpose, some without a descriptor, some of another schema.
_REPOSITORIES = ORACLES["url_normalize"].replace("SELECT page_id, CASE", ", n AS (SELECT page_id, CASE", 1) + """),
d AS (SELECT 'c-' || page_id AS collection, slug AS name, remote AS repo_key, CASE WHEN page_id % 11 = 5 THEN 2 ELSE 1 END AS schema_version FROM n WHERE page_id % 7 <> 3),
x AS (SELECT 'c-' || p.page_id AS collection, name, repo_key, coalesce(name IS NOT NULL AND repo_key IS NOT NULL AND schema_version = 1, FALSE) AS ok FROM pages p LEFT JOIN d ON d.collection = 'c-' || p.page_id WHERE p.page_id % 5 <> 4)"""


def _catalog(spark, sf_dir):
    named = url_normalize(spark, sf_dir).withColumn("collection", F.concat(F.lit("c-"), "page_id"))
    collections = named.select("collection", F.when(F.col("page_id") % 5 == 4, "other").otherwise("corpus").alias("purpose"))
    own = named.where("page_id % 7 <> 3").select("collection", F.col("slug").alias("name"), F.col("remote").alias("repo_key"), F.when(F.col("page_id") % 11 == 5, 2).otherwise(1).alias("schema_version"))
    return catalog.discovered(collections, own, "corpus"), named


@query(_REPOSITORIES + " SELECT collection, CASE WHEN ok THEN 'ready' ELSE 'partial' END AS status, CASE WHEN ok THEN repo_key END AS repo_key, CASE WHEN ok THEN name END AS name FROM x")
def catalog_discovery(spark, sf_dir):
    return _catalog(spark, sf_dir)[0]


@query(_REPOSITORIES + """, e AS (SELECT DISTINCT collection, unnest([name, repo_key, nullif(regexp_extract(repo_key, '^[^/]*/(.+)$', 1), ''), collection]) AS selector FROM x WHERE ok),
s AS (SELECT DISTINCT unnest([remote, slug, regexp_extract(remote, '^[^/]*/(.+)$', 1), 'c-' || page_id]) AS selector FROM n)
SELECT s.selector, count(e.collection) AS matches, CASE WHEN count(e.collection) = 1 THEN min(e.collection) END AS collection FROM s LEFT JOIN e ON e.selector = s.selector WHERE s.selector IS NOT NULL GROUP BY s.selector""")
def catalog_selection(spark, sf_dir):
    """Repositories asked for by every name, key, key without host and collection of all pages."""
    found, named = _catalog(spark, sf_dir)
    asked = named.select(F.explode(F.array("remote", "slug", F.regexp_extract("remote", r"\A[^/]*/(.+)\z", 1), "collection")).alias("selector")).where("selector IS NOT NULL")
    return catalog.selected(found.where("status = 'ready'"), asked)


@query(f"""WITH {_A}, {_B}, r AS (SELECT coalesce(b.path, a.path) AS id, a.path AS l, b.path AS f, a.oid AS lh, b.oid AS fh, a.language AS lf, b.mode AS ff FROM (SELECT *, mode AS m FROM a) a FULL JOIN b ON a.path = b.path)
SELECT 'record-missing' AS check_name, id, lh AS detail FROM r WHERE f IS NULL UNION ALL SELECT 'record-not-listed', id, fh FROM r WHERE l IS NULL
UNION ALL SELECT 'record-hash', id, fh FROM r WHERE l IS NOT NULL AND f IS NOT NULL AND lh <> fh UNION ALL SELECT 'record-file', id, ff FROM r WHERE l IS NOT NULL AND f IS NOT NULL AND ff <> lf""")
def record_violations(spark, sf_dir):
    """Entries of version B against the list of version A; what B calls the file of an entry is its mode, which A's list never has."""
    listed = tree(spark, sf_dir, "A").select(F.col("path").alias("id"), text.language(F.col("path")).alias("file_id"), F.col("oid").alias("hash"))
    found = tree(spark, sf_dir, "B").select(F.col("path").alias("id"), F.col("mode").alias("file_id"), F.col("oid").alias("hash"))
    return checks.records(found, listed)


@query("""WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN upper(sha256(o_orderkey::VARCHAR)) ELSE sha256(o_orderkey::VARCHAR) END AS commit, '{"n":' || o_custkey || '}' AS config FROM orders),
c AS (SELECT *, CASE WHEN k % 5 = 0 THEN sha256('') ELSE sha256(config) END AS config_hash FROM b), d AS (SELECT *, sha256('["c","' || commit || '","' || config_hash || '","loamline-builder-1"]') AS due FROM c),
e AS (SELECT *, CASE WHEN k % 7 = 0 THEN sha256(k::VARCHAR) ELSE due END AS id FROM d)
SELECT 'commit-form' AS check_name, id, commit AS detail FROM e WHERE k % 6 = 0 UNION ALL SELECT 'config-hash', id, sha256(config) FROM e WHERE k % 5 = 0 UNION ALL SELECT 'build-id', id, due FROM e WHERE k % 7 = 0""")
def identity_violations(spark, sf_dir):
    """Orders as builds, some with a commit, a configuration or a name that does not hold."""
    k, key = F.col("o_orderkey"), F.sha2(F.col("o_orderkey").cast("string"), 256)
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("c").alias("repository"), F.when(k % 6 == 0, F.upper(key)).otherwise(key).alias("commit"), F.concat(F.lit('{"n":'), "o_custkey", F.lit("}")).alias("config"))
    b = b.withColumn("config_hash", F.sha2(F.when(k % 5 == 0, F.lit("")).otherwise(F.col("config")), 256))
    due = identity.build_id(F.col("repository"), F.col("commit"), F.col("config_hash"), BUILDER)
    return checks.identities(b.withColumn("build_id", F.when(k % 7 == 0, key).otherwise(due)), BUILDER)


def _letters(texts: list[str]) -> list[list[float]]:
    return [[t.count("e"), t.count("\n"), len(t)] for t in texts]


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN 'structural-only' WHEN lang = 'de' THEN 'imports-only' END AS reason FROM documents)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'embedded' ELSE 'skipped' END AS embedding_status, coalesce(reason, '') AS embedding_skip_reason, CASE WHEN reason IS NULL THEN (len(t) - len(replace(t, 'e', '')))::DOUBLE ELSE -1 END AS e,
  CASE WHEN reason IS NULL THEN (len(t) - len(replace(t, chr(10), '')))::DOUBLE ELSE -1 END AS lines, CASE WHEN reason IS NULL THEN len(t)::DOUBLE ELSE -1 END AS size FROM d""")
def embedded_documents(spark, sf_dir):
    """Documents embedded by counts of letters, through a cache that holds those of one language."""
    model = embedding.Embedder("letters", 3, _letters)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("search_text"))
    docs = docs.withColumn("chunk_kind", F.when(F.col("search_text") == "", "structural").when(F.col("lang") == "de", "imports").otherwise("documentation"))
    cache = stored(embedding.embedded(docs.where("lang = 'en'"), model)[1], "vectors")
    done, _ = embedding.embedded(docs, model, cache)
    part = lambda k: F.coalesce(F.col("embedding")[k], F.lit(-1.0))
    return done.select("doc_id", "embedding_status", F.coalesce("embedding_skip_reason", F.lit("")).alias("embedding_skip_reason"), part(0).alias("e"), part(1).alias("lines"), part(2).alias("size"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_customers(spark, sf_dir):
    return versions.obsolete(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return versions.obsolete(table(spark, sf_dir, "customer"), urgent, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def nation_reconciliation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ck")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sk")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, F.col("ck") == F.col("sk"), "full_outer").select(F.coalesce("ck", "sk").alias("nation"), "customers", "suppliers")


def _fold_sql(most_rows: int | None, most_bytes: int, each: int) -> str:
    """A loop over rows ``r`` (row from 0, size) in SQL: ``f`` has the batch of each."""
    full = f"held + size > {most_bytes}" + (f" OR count >= {most_rows}" if most_rows else "")
    return f"""f AS (SELECT row, 0 AS batch, 1 AS count, {each} + size AS held FROM r WHERE row = 0
  UNION ALL SELECT r.row, batch + ({full})::INT, CASE WHEN {full} THEN 1 ELSE count + 1 END, size + CASE WHEN {full} THEN {each} ELSE held END FROM f JOIN r ON r.row = f.row + 1)"""


@query(f"""WITH RECURSIVE {_ALL}, r AS (SELECT row_number() OVER (ORDER BY path) - 1 AS row, path, bytes + 200 AS size FROM a), {_fold_sql(50, 200_000, 32)}
  SELECT batch::BIGINT AS batch, count(*) AS n, sum(size)::BIGINT AS bytes, min(path) AS first_path, max(path) AS last_path FROM f JOIN r USING (row) GROUP BY batch""")
def mutation_batches(spark, sf_dir):
    """All records in one order, packed greedily into bounded batches."""
    rows = tree(spark, sf_dir).select("path", (F.col("bytes") + 200).alias("size"))
    return packing.pack(rows, ["path"], "size", most_rows=50, most_bytes=200_000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query(f"""WITH RECURSIVE {_ALL}, r AS (SELECT row_number() OVER (ORDER BY path) - 1 AS row, e, length(e) AS size FROM (SELECT path, coalesce(reason, 'included') || ' ' || oid || ' ' || path AS e FROM a)), {_fold_sql(None, 4_000, 0)}
  SELECT batch::BIGINT AS part, count(*) AS n_entries, sum(size)::BIGINT AS bytes, sha256(string_agg(sha256(e), ',' ORDER BY row)) AS part_hash FROM f JOIN r USING (row) GROUP BY batch""")
def inventory_parts(spark, sf_dir):
    """The inventory in order, in bounded parts, each named by a hash of its entries."""
    rows = classify.classified(tree(spark, sf_dir)).select("path", F.concat_ws(" ", F.coalesce("reason", F.lit("included")), "oid", "path").alias("entry"))
    return packing.parts(rows, ["path"], "entry", most_bytes=4_000)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the corpus, searched with a filter, with excerpts and citations."""
    # Counted, scored and cited from one table: cutting is the costly part.
    c = stored(chunking.chunks(_included(spark, sf_dir), config_hash(preset())), "chunks")
    index = search.Index.write(c, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", attributes=("language",))
    best = index.ranked(QUERY, 10, where={"language": "markdown"})
    cite = text.citation(F.lit("A"), F.col("path"), F.col("start_line"), F.col("end_line"))
    return best.join(c, "id").select("id", "score", "path", "chunk_kind", text.excerpt(F.col("search_text")).alias("excerpt"), cite.alias("citation")).orderBy(F.desc("score"), "id")


@query()
def search_and_cite(spark, sf_dir):
    return flagship(spark, sf_dir)
