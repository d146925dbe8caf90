"""Edges of classification, chunking, checks and publication on small inline trees."""

import base64
import dataclasses
import hashlib
import json
import math
import os
import random
import subprocess
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.functions import identity, text
from loamline.operators import checks, chunking, classify, hash_tree, packing, search
from loamline.plans.build import build, preset
from loamline.plans.corpus import Corpus
from loamline.sources import git


def entries(spark, rows):
    df = spark.createDataFrame(rows, "path string, content string")
    return df.select("path", F.lit("100644").alias("mode"), F.sha2("content", 256).alias("oid"), F.octet_length("content").cast("bigint").alias("bytes"), "content")


def test_exclusion_order(spark):
    rows = [
        ("a.txt", "100644", b"fine"), ("b.bin", "100644", b"\x01\x00\xff"), ("c.txt", "100644", b"\xff\xfe"), ("l.txt", "100644", (classify.POINTER + "\r\noid").encode()), ("vendor/x.ts", "100644", b"x"),
        ("a/build", "100644", b"x"), ("a/build\n", "100644", b"x"), ("p.PNG", "100644", b"x"), ("m.min.js", "100644", b"x"), ("s", "120000", b"a.txt"), ("sub", "160000", b""), (None, "100644", b"x"), ("e.txt", "100644", b""), ("big", "100644", b"x" * (1 << 20) + b"x"),
    ]
    df = spark.createDataFrame([(p, m, len(c), bytearray(c)) for p, m, c in rows], "path string, mode string, bytes bigint, content binary")
    got = {r.path: r.reason for r in classify.classified(df).collect()}
    assert got == {
        "a.txt": None, "b.bin": "binary-content", "c.txt": "invalid-utf8-content", "l.txt": "lfs-pointer", "vendor/x.ts": "dependency-or-build-output", "a/build": "dependency-or-build-output", "a/build\n": None, "p.PNG": "binary-extension",
        "m.min.js": "generated-output", "s": "symlink", "sub": "submodule", None: "invalid-utf8-path", "e.txt": None, "big": "oversized",
    }


def test_text_functions(spark):
    row = spark.createDataFrame([("﻿# a\r\n\n😀\nend",)], "t string").select(
        text.lines(F.col("t")).alias("lines"), text.line_count(F.col("t")).alias("n"), text.line_at_byte(F.col("t"), F.lit(8)).alias("at"), text.first_token(F.col("t")).alias("first"),
        text.enrichment(F.lit("p"), F.lit(""), F.lit("s")).alias("rich"), text.language(F.lit("Makefile")).alias("l1"), text.language(F.lit("java")).alias("l2"), identity.base64(F.repeat(F.lit("x"), 100)).alias("b"),
    ).first()
    assert row.lines == ["﻿# a\r\n", "\n", "😀\n", "end"] and row.n == 4 and row["at"] == 2
    assert row.first == "#" and row.rich == "p\ns\n" and (row.l1, row.l2) == ("text", "java") and "\n" not in row.b


@pytest.mark.parametrize("raw, key", [("git@GitHub.com:Owner/Repo.git", "github.com/owner/repo"), ("https://user:pw@github.com/Owner/Repo/", "github.com/owner/repo"), ("ssh://git@host.org:22/A/b.git", "host.org:22/A/b"), ("/local/path", None), ("https://h/a/../b", None), ("https://h/a?x", None)])
def test_remotes(spark, raw, key):
    assert spark.range(1).select(text.normalized_remote(F.lit(raw)).alias("k")).first().k == key


SOURCES = {
    "a.java": "﻿package x;\r\nimport y.Z;\r\n\r\npublic class A {\r\n  void f() { String s = \"}\"; }\r\n}\r\n// 😀\r\n", "b.ts": "import a from 'b';\nexport function f(x: number) {\n  return `}${x}`;\n}\n\nclass K {\n  m() {}\n}\n",
    "broken.ts": "function f( {\n" + "x" * 5100, "long.txt": " ".join(f"w{i}" for i in range(4000)), "doc.md": "# T\n\npara\n```\n# not a heading\n\n```\n## Next\ntext\n", "c.yaml": "a: 1\nb:\n  - c\n", "t.txt": "<|endoftext|> plain", "empty.ts": "",
    "blank.md": "\n \n\t\n", "lines.txt": "\n".join("one two three four five" for _ in range(900)),
}


def test_chunks_cover_their_files(spark):
    rows = chunking.chunks(entries(spark, list(SOURCES.items())), "cfg").collect()
    for path, source in SOURCES.items():
        raw, own = source.encode(), sorted((r for r in rows if r.path == path), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own))) and bool(own) == bool(raw)
        covered = 0
        for r in own:
            assert r.start_byte <= covered < r.end_byte and r.token_count <= chunking.MOST
            body = raw[r.start_byte : r.end_byte].decode()
            assert r.search_text.endswith(body) and r.start_line == raw[: r.start_byte].count(b"\n") + 1 and r.end_line == raw[: max(r.start_byte, r.end_byte - 1)].count(b"\n") + 1
            covered = r.end_byte
        assert covered == len(raw)
    by = {p: [r for r in rows if r.path == p] for p in SOURCES}
    assert len(by["long.txt"]) > 4 and by["broken.ts"][0].parse_status == "parse-error-fallback"
    assert {r.chunk_kind for r in by["blank.md"]} == {"structural"}
    assert {(r.chunk_kind, r.symbol) for r in by["b.ts"]} >= {("function", "f")}


def test_line_units_agree_with_windows(spark):
    from loamline.operators import units

    rng = random.Random(3)
    parts = ["# h\n", "\n", "text\n", "```\n", "a: 1\n", "[s]\n", "  - x\n", "~~~ js\n"]
    files = [(f"{i}.{e}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(30) for e in ("md", "ini")]
    for ending, markdown in (("md", True), ("ini", False)):
        own = [f for f in files if f[0].endswith(ending)]
        got = units.units(units.line_table(entries(spark, own)), markdown).collect()
        assert {(r.path, r.start_byte, r.end_byte) for r in got} == {(p, u.start, u.end) for p, t in own for u in chunking.line_units(t, markdown)}


def test_build_checks_publish_search_read(spark, tmp_path):
    a = entries(spark, [*SOURCES.items(), ("gone.txt", "bye\n"), ("vendor/v.ts", "x")])
    b = entries(spark, [*[(p, s + "changed\n" if p == "doc.md" else s) for p, s in SOURCES.items()], ("new.md", "# New\n"), ("vendor/v.ts", "x")])
    first = build(a)
    second = build(b, previous=first)
    assert {(r.path, r.change) for r in second.changes.collect() if r.change != "unchanged"} == {("gone.txt", "deleted"), ("doc.md", "modified"), ("new.md", "added")}
    again = build(b)
    key = lambda d: sorted((r.id, r.hash) for r in d.records().collect())
    assert key(again) == key(second)
    assert second.obsolete.count() == len({r[0] for r in key(first)} - {r[0] for r in key(second)})

    corpus = Corpus(spark, str(tmp_path / "c"), "demo")
    one, two = hashlib.sha1(b"1").hexdigest(), hashlib.sha1(b"2").hexdigest()
    tag = corpus.publish(first, one, "2024-01-02T00:00:00+09:00")
    before = corpus.read(one, "doc.md").first().text
    assert corpus.publish(first, one, "2024-01-02T00:00:00+09:00") == tag and corpus.versions().count() == 1
    with pytest.raises(ValueError):
        corpus.publish(second, one, "2024-01-02T00:00:00+09:00")
    corpus.release(spark.createDataFrame([("refs/tags/v2", two, "2024-01-01 00:00:00"), (f"refs/tags/{one[:8]}", two, "2024-01-01 00:00:00")], "ref string, commit string, at string"))
    for selector in ("v2", one[:8]):  # a known name goes before a commit, also while pending
        with pytest.raises(LookupError):
            corpus.resolve(selector)
    corpus.publish(second, two, "2024-01-01T23:00:00+00:00")
    assert corpus.resolve("v2").commit == two and corpus.resolve(one[:9]).commit == one and [r.commit for r in corpus.versions().collect()] == [two, one]
    assert corpus.read(one, "doc.md").first().text == before == SOURCES["doc.md"]
    part = corpus.read("v2", "doc.md", 3, 3, context=1).first()
    assert part.text == "\npara\n```\n" and part.citation == f"corpus@{two}:doc.md:2-4"
    with pytest.raises(LookupError, match="dependency-or-build-output"):
        corpus.read("v2", "vendor/v.ts")
    hits = corpus.search("v2", "Next heading", 5, language="markdown").collect()
    assert hits and {h.path for h in hits} == {"doc.md"} and hits[0].score == max(h.score for h in hits)
    again = corpus.open(hits[0].handle).first()
    assert again.path == "doc.md" and (again.start_line, again.end_line) == (hits[0].start_line, hits[0].end_line) and again.citation.endswith(hits[0].citation.split("@")[1])
    with pytest.raises(LookupError, match="another corpus"):
        Corpus(spark, corpus.root, "other").open(hits[0].handle)
    with pytest.raises(ValueError):
        corpus.open("ev1.?")
    forged = json.loads(base64.b64decode(hits[0].handle[4:]))
    forged[5] = str(int(forged[5]) + 1)
    with pytest.raises(LookupError, match="no chunk"):
        corpus.open("ev1." + base64.b64encode(json.dumps(forged).encode()).decode())
    snapshot = corpus.resolve("v2").snapshot
    kept = spark.createDataFrame(spark.read.parquet(f"{snapshot}/inventory").collect(), spark.read.parquet(f"{snapshot}/inventory").schema)
    kept.where("path <> 'doc.md'").write.mode("overwrite").parquet(f"{snapshot}/inventory")
    with pytest.raises(Exception, match="not in the inventory"):
        corpus.search("v2", "Next heading", 5).collect()


def test_checks_find_each_corruption(spark):
    own = build(entries(spark, list(SOURCES.items())))
    files, parts, listed = (spark.createDataFrame(d.collect(), d.schema) for d in (own.files, own.chunks, own.inventory))
    names = lambda f=files, c=parts, i=listed: {r.check_name for r in checks.violations(f, c, i, own.config_hash).collect()}
    assert names() == set()
    long_ = F.col("path") == "long.txt"
    assert names(c=parts.where(~(long_ & (F.col("ordinal") == 1)))) >= {"coverage-gap", "chunk-count"}
    assert "coverage-short" in names(c=parts.where(~long_))
    assert "duplicate-id" in names(c=parts.unionByName(parts.where(long_).limit(1)))
    assert names(f=files.where(~long_)) >= {"orphan-chunk", "file-missing"}
    assert "file-content-hash" in names(f=files.withColumn("source_text", F.when(long_, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text"))))
    assert "chunk-text" in names(c=parts.withColumn("search_text", F.when(long_, "x").otherwise(F.col("search_text"))))
    assert "chunk-ordinals" in names(c=parts.withColumn("ordinal", F.col("ordinal") + F.when(long_, 1).otherwise(0)))
    assert "chunk-lines" in names(c=parts.withColumn("start_line", F.col("start_line") + F.when(long_, 1).otherwise(0)))


def test_units_have_scopes_and_cover(spark):
    source = "import a from 'b';\n\nexport class K<T>\n{\n  x = 1;\n\n  // about m\n  m(a: number): void {\n    return `}`;\n  }\n  class L {\n    n() {}\n  }\n}\n\nfunction f() {\n}\n"
    found = chunking.brace_units(source, "a.ts", chunking.words_and_marks().count)
    assert [(u.kind, u.scope, u.symbol) for u in found] == [
        ("imports", None, None), ("declaration", "K", None), ("declaration", "K", None), ("documentation", "K", None), ("function", "K", "m"), ("declaration", "K.L", None), ("function", "K.L", "n"), ("function", None, "f"),
    ]
    assert "".join(source[u.start : u.end] for u in found) == source and not any(source[u.start].isspace() for u in found)
    deep = "class a {\n" * 3000 + "}\n" * 3000
    own = chunking.spans(deep, "a.java")[1]
    assert own[0].start == 0 and own[-1].end == len(deep) and all(a.end == b.start for a, b in zip(own, own[1:]))


def test_large_functions_are_entered():
    body = "".join(f"  step{i}(value, other);\n" for i in range(600))
    own = chunking.spans(f"class K {{\n  go() {{\n{body}  }}\n}}\n", "k.js")[1]
    assert len(own) > 2 and {u.scope for u in own} == {"K", "K.go"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_vocabulary_counts(spark, name):
    places = pytest.importorskip("public_tokenizers")
    path = places.path(name)
    counter = chunking.vocabulary(path)
    own = build(entries(spark, list(SOURCES.items())), tokenizer=path)
    rows = own.chunks.collect()
    assert own.config["counter"] == counter.name and rows
    assert all(r.token_count == counter.count(r.search_text) <= chunking.MOST for r in rows)
    assert checks.violations(own.files, own.chunks, own.inventory, own.config_hash).count() == 0 and checks.recount(own.chunks, path).count() == 0
    assert checks.recount(own.chunks).count() > 0  # counted in another way
    with pytest.raises(ValueError):
        build(entries(spark, [("a.txt", "x")]), preset(), tokenizer=path)


def test_catalogue(spark, tmp_path):
    from loamline.plans.corpus import Catalog

    all_ = Catalog(spark, str(tmp_path))
    assert all_.repositories().count() == 0
    one = all_.register("Tool", "git@github.com:Ann/Tool.git", "first", {"team": "x"})
    two = all_.register("Tool", "https://example.org/ann/tool")
    assert all_.register("Renamed", "https://github.com/ann/tool/") == one and one != two
    assert {(r.collection, r.name) for r in all_.repositories().collect()} == {(one, "Renamed"), (two, "Tool")}
    assert all_.select("Tool").name == two == all_.select("example.org/ann/tool").name and all_.select(one).name == one
    for bad, why in (("ann/tool", "ambiguous"), ("none", "not registered")):
        with pytest.raises(LookupError, match=why):
            all_.select(bad)
    with pytest.raises(ValueError):
        all_.register("x", "/local")
    spark.createDataFrame([("lost", "source-corpus")], "collection string, purpose string").selectExpr("*", "current_timestamp() AS at").write.mode("append").parquet(f"{tmp_path}/collections")
    assert all_.discover().where("collection = 'lost'").first().status == "partial"


def test_embedding_through_a_cache(spark):
    from loamline.operators import embedding

    rows = spark.createDataFrame([(1, "function", "a"), (2, "function", "a"), (3, "imports", "b"), (4, "structural", None), (5, "function", "c"), (6, None, None)], "id int, chunk_kind string, search_text string")
    model = embedding.Embedder("m", 2, lambda texts: [[len(t), 1] for t in texts])
    done, new = embedding.embedded(rows, model)
    got = {r.id: (r.embedding, r.embedding_status, r.embedding_skip_reason) for r in done.collect()}
    assert got == {1: ([1, 1], "embedded", None), 2: ([1, 1], "embedded", None), 3: (None, "skipped", "imports-only"), 4: (None, "skipped", "structural-only"), 5: ([1, 1], "embedded", None), 6: ([0, 1], "embedded", None)}
    assert new.count() == 3 and checks.embeddings(done, 2).count() == 0
    cache = spark.createDataFrame(new.collect(), new.schema)
    assert embedding.embedded(rows, model, cache)[1].count() == 0
    assert embedding.embedded(rows, embedding.Embedder("n", 2, model.embed), cache)[1].count() == 3
    bad = cache.withColumn("embedding", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="not a valid vector"):
        embedding.embedded(rows, model, bad)[0].collect()
    wrong = done.withColumn("embedding", F.when(F.col("id") == 1, F.array(F.lit(float("nan")), F.lit(1.0))).when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("embedding"))).withColumn("embedding_skip_reason", F.when(F.col("id") == 4, None).otherwise(F.col("embedding_skip_reason")))
    assert {(r.check_name, r.id) for r in checks.embeddings(wrong, 2).collect()} == {("embedding-vector", "1"), ("embedding-state", "3"), ("embedding-reason", "4")}


def test_canonical_json(spark):
    import json

    value = "\x1f\x0b \\u001F \\\\u000B \u007f\u2028\"é"
    got = spark.createDataFrame([(2, value, None)], "b int, a string, c string").select(identity.canonical_json("b", "a", "c").alias("j")).first().j
    assert got == json.dumps({"a": value, "b": 2}, separators=(",", ":"), ensure_ascii=False)


def test_verified_versions(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), "demo")
    own, commit = build(entries(spark, list(SOURCES.items()))), hashlib.sha1(b"1").hexdigest()
    with pytest.raises(ValueError, match="commit-form"):
        corpus.publish(own, "not-a-commit", "2024")
    corpus.publish(own, commit, "2024")
    assert corpus.verify(commit).count() == 0
    at = f"{corpus.resolve(commit).snapshot}/records"
    listed = spark.createDataFrame(spark.read.parquet(at).collect(), spark.read.parquet(at).schema)
    listed.where("id NOT LIKE 'f-%'").unionByName(listed.limit(1).withColumn("id", F.lit("x"))).write.mode("overwrite").parquet(at)
    assert {r.check_name for r in corpus.verify(commit).collect()} == {"record-not-listed", "record-missing"}
    corpus.release(spark.createDataFrame([("refs/tags/v", commit, "2024-01-01 00:00:00")], "ref string, commit string, at string"))
    assert corpus.resolve("v").commit == commit
    spark.createDataFrame([("ver-other",)], "target string").select(identity.release_alias(F.lit("refs/tags/v")).alias("alias"), "target", F.expr("current_timestamp() + INTERVAL 1 HOUR").alias("at")).write.mode("append").parquet(f"{corpus.root}/aliases")
    assert corpus.releases().first().status == "out-of-sync"
    with pytest.raises(LookupError, match="out-of-sync"):
        corpus.resolve("v")


@pytest.mark.parametrize("most_rows, most_bytes, each, n", [(500, 4_900_000, 32, 1), (7, 900, 32, 9000), (None, 300, 0, 5000), (3, 10**9, 0, 1000), (50, 1, 32, 40), (1, 100, 0, 30)])
def test_packing_is_the_loop(spark, most_rows, most_bytes, each, n):
    """Rows of size 0 and null, rows over the limit alone, and batches across the blocks that sums are made in."""
    rng = random.Random(n)
    rows = [(k, rng.choice([0, None, 1, 30, 120, 120, 1200])) for k in range(n)]
    want, batch, count, held = {}, 0, 0, each
    for k, size in rows:
        if count and (most_rows and count >= most_rows or held + (size or 0) > most_bytes):
            batch, count, held = batch + 1, 0, each
        want[k], count, held = batch, count + 1, held + (size or 0)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, size bigint").repartition(5)
    got = {r.k: (r.row_, r.batch) for r in packing.pack(df, ["k"], "size", most_rows, most_bytes, each).collect()}
    assert got == {k: (k, b) for k, b in want.items()}


def test_trees_read_only_what_differs(spark, tmp_path):
    rows = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    other = rows.where("id <> 'k17'").withColumn("hash", F.when(F.col("id") == "k4000", "x").otherwise(F.col("hash"))).unionByName(spark.createDataFrame([("new", "y"), (None, None)], "id string, hash string"))
    a, b = (hash_tree.Ranged.write(x, str(tmp_path / n), 3) for x, n in ((rows, "a"), (other.repartition(3), "b")))
    got = a.against(b)
    assert {r.id for r in got.collect()} == {"k17", "k4000", "new", None} or {r.id for r in got.collect()} == {"k17", "k4000", "new"}
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters: [" in x and "top" in x.split("PartitionFilters: [")[1].split("]")[0]]
    assert len(scans) >= 2 and all(" IN (" in x for x in scans) and hash_tree.differing(a.tree, b.tree, 3).count() <= 4 and len(os.listdir(tmp_path / "a" / "rows")) > 16
    same = hash_tree.Ranged.write(rows.repartition(7), str(tmp_path / "c"), 3)
    root = lambda r: r.tree.where("prefix = ''").first().digest
    assert a.against(same).count() == 0 and root(a) == root(same) != root(b) and a.tree.where("prefix = ''").first().n == 6000
    leaf = sorted(f"k{k}:{hashlib.sha256(str(k).encode()).hexdigest()}" for k in range(6000) if hashlib.sha256(f"k{k}".encode()).hexdigest()[:3] == "000")
    assert a.tree.where("prefix = '000'").first().digest == hashlib.sha256("\n".join(leaf).encode()).hexdigest()
    assert hash_tree.tree(rows.limit(0), 2).count() == 0 and hash_tree.depth_for(10) == 2 and hash_tree.depth_for(10**10) == 6


def test_parts_of_an_inventory(spark):
    entries = spark.createDataFrame([(k, "e" * (k % 40)) for k in range(300)], "k int, e string")
    got = packing.parts(entries, ["k"], "e", 100).orderBy("part").collect()
    assert sum(p.n_entries for p in got) == 300 and max(p.bytes for p in got) <= 100 and [p.part for p in got] == list(range(len(got)))
    whole = packing.parts(entries, ["k"], "e").first()
    assert whole.part_hash == hashlib.sha256(",".join(hashlib.sha256(b"e" * (k % 40)).hexdigest() for k in range(300)).encode()).hexdigest()
    assert packing.parts(entries.limit(0), ["k"], "e").count() == 0
    with pytest.raises(Exception, match="too large"):
        packing.parts(entries, ["k"], "e", 100, single=39).collect()


def test_chunks_are_made_in_bounded_batches():
    """A worker gives out what it has cut before it goes on, however many files one batch brings."""
    body = "".join(f"key{i}: {'value ' * 20}\n" for i in range(400))
    files = [(f"d/{i}.yaml", body, f"{i}") for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], names=["path", "content", "content_hash"])
    out = list(chunking._chunked("syntax", None)(iter([batch])))
    assert len(out) > 5 and max(b.nbytes for b in out) < 3 * chunking._HELD < sum(b.nbytes for b in out)
    got = [(p, k) for b in out for p, k in zip(b.column("path").to_pylist(), b.column("ordinal").to_pylist(), strict=True)]
    each = len(chunking.spans(body, "d/0.yaml")[1])
    assert got == [(f[0], k) for f in files for k in range(each)]


def test_chunks_and_recounts_are_dealt_and_bounded(spark, monkeypatch):
    """Files of one partition are dealt by path before they are cut; a recount goes through slices too, null texts included."""
    files = spark.createDataFrame([(f"{i}.md", "# A\n\nb\n") for i in range(20)], "path string, content string").coalesce(1)
    assert "hashpartitioning(path" in chunking.chunks(files, "c")._jdf.queryExecution().executedPlan().toString()
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "c"])], names=["t"])
    assert [b.column("t").to_pylist() for b in chunking._slices(batch, "t", 3000)] == [["aa", None, "b" * 50], ["c"]]
    assert [b.num_rows for b in chunking._slices(batch, "t", 20)] == [1, 1, 1, 1]
    got = chunking.counted(spark.createDataFrame([("a b",), (None,)], "search_text string")).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2]


def test_a_text_is_counted_once():
    """Units that merge, are cut or are entered are not counted again; a name is not looked for anew in each letter of a long run."""
    own, handed = chunking.words_and_marks(), []
    counter = dataclasses.replace(own, count=lambda text: handed.append(text) or own.count(text))
    long = "class K {\n" + "".join(f"  go{i}() {{\n{'    a.b(c);' * 9}\n  }}\n" for i in range(300)) + "}\n"
    for path, text in {"a.md": "one two\n\n" * 3000, "a.txt": "\u00e9 b1_\u0661 \U0001f600x\x1cy\ufeff" * 900, "a.ts": long}.items():
        handed.clear()
        found, whole = chunking.spans(text, path, counter=counter)[1], chunking.Counted(text, own)
        assert len(found) > 2 and sum(map(len, handed)) < len(text)
        assert [m.span() for m in chunking._TOKEN.finditer(text)] == list(zip(whole.begins, whole.ends))
        assert all(whole.of(path + "\n", u.start, u.end) == own.count(path + "\n" + text[u.start : u.end]) for u in found)
    began = time.perf_counter()
    chunking.spans("a" * 40_000 + ";\n", "a.ts")
    assert time.perf_counter() - began < 5


def test_lines_are_counted_from_bytes_that_are_encoded_once(spark):
    """As lines before the bytes of whole files, for ranges that are wrong too: reversed, beyond the file, before it, inside a character, unknown."""
    body = "\n\u00e9\na\U0001f600b\n\nlast"
    data = body.encode()
    files = spark.createDataFrame([("f", "p", "h", len(data), 1, body, "c")], "id string, path string, content_hash string, byte_length bigint, chunk_count bigint, source_text string, config_hash string")
    at = lambda offset: data[: max(0, offset)].count(b"\n") + 1
    ranges = [(a, b) for a in (-3, 0, 1, 2, 7, len(data), 99) for b in (-1, 0, 3, 8, 12, len(data), 99)] + [(None, 4), (2, None), (None, None)]
    rows, due = [], set()
    for n, (a, b) in enumerate(ranges):
        high = max([x for x in (a, None if b is None else b - 1) if x is not None], default=None)
        right = at(a) if a is not None else 1, at(high) if high is not None else 1
        for k, (first, last) in enumerate([right, (right[0] + 1, right[1]), (right[0], right[1] + 1)]):
            rows.append((f"{n}-{k}", "f", "p", "h", "c", a, b, first, last, 0, None, None, body, 1))
            if (a is not None and first != right[0]) or (high is not None and last != right[1]):
                due.add(f"{n}-{k}")
    names = "id string, file_id string, path string, content_hash string, config_hash string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, ordinal bigint, scope string, symbol string, search_text string, token_count bigint"
    listed = spark.createDataFrame([("p", "included", "f", "h")], "path string, status string, file_id string, content_hash string")
    found = checks.violations(files, spark.createDataFrame(rows, names), listed, "c")
    assert {r.id for r in found.where("check_name = 'chunk-lines'").collect()} == due and len(due) > 80
    assert found.where("check_name = 'chunk-lines'")._jdf.queryExecution().optimizedPlan().toString().count("encode(source_text") == 1


def test_texts_that_are_gone_are_gone_through_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    old = [(f"o{i}", ["alpha beta beta", "alpha", "", None][i % 4]) for i in range(40)]
    gone, new = [x for x in old if int(x[0][1:]) < 10], [("n1", "beta gamma")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, search_text string")
    less = frame(gone).withColumn("search_text", F.udf(read).asNondeterministic()("search_text"))
    search.Index.write(frame(old), f"{tmp_path}/a")
    search.Index.write(frame(new), f"{tmp_path}/b", less=less)
    assert seen.value == len(gone)
    whole = search.Index.write(frame([x for x in old if x not in gone] + new), f"{tmp_path}/c")
    names = frame(gone).select(F.col("id").alias("gone_id"))
    parts = search.Index(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], lambda hits: hits.join(names, (F.col("id") == F.col("gone_id")) & (F.col("segment_") == 0), "left_anti"))
    assert parts.totals().first() == whole.totals().first()
    assert parts.ranked("alpha beta gamma", 50).collect() == whole.ranked("alpha beta gamma", 50).collect()
    nothing = search.Index.write(frame(new), f"{tmp_path}/d", less=frame(gone).limit(0))
    assert tuple(nothing.totals().first()) == (2, 1)


def test_index_reads_only_its_terms(spark, tmp_path):
    rows = [(i, f"alpha {'beta ' * (i % 3)}word{i}") for i in range(200)] + [(900, None), (901, "")]
    index = search.Index.write(spark.createDataFrame(rows, "id bigint, search_text string"), str(tmp_path / "i"))
    plan = index.hits(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    got = index.ranked("Word7 beta", 5).collect()
    assert got[0].id == 7 and len(got) == 5 and index.ranked("nothing", 5).count() == 0
    assert [r.id for r in index.ranked("alpha", 3, spark.createDataFrame([(5,), (5,), (6,)], "id bigint")).collect()] == [6, 5]


def test_index_packs_postings(spark, tmp_path, monkeypatch):
    """A row for a term in a block, not for a posting; texts of one file are packed by several tasks, and long ones by themselves."""
    monkeypatch.setattr(search.Index, "WORDS", 300)
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 40)) + " é.x don't" * (i % 2), None if i % 3 else "a") for i in range(800)] + [(900, None, "b"), (901, "w1 " * 1000, "b")]
    docs = spark.createDataFrame(texts, "id bigint, search_text string, kind string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these texts are few
    index = search.Index.write(docs, str(tmp_path / "i"), attributes=("kind",))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = ["w1", "w7", "é.x", "don't", "none"]
    due = search.postings(docs, attributes=("kind",)).where(F.col("term").isin(wanted))
    columns = ["term", "id", "length", "tf", "kind"]
    found = sorted(map(tuple, index.hits(wanted).select(columns).collect()), key=repr)
    assert found == sorted(map(tuple, due.select(columns).collect()), key=repr) and len(found) > 500
    rows = index._rows(index.at[0])
    assert rows.where("term IS NOT NULL").agg(F.sum("n")).first()[0] == search.postings(docs).count()
    assert rows.where("term IS NOT NULL").count() < search.postings(docs).count() / 4
    assert rows.where("term IS NULL").select(F.shiftright("block", 32)).distinct().count() > 1
    assert index.totals().first().n == 802


def blocks_of(index, wanted, limit, **given):
    """Blocks that hold a term of a query, and those that are read for it."""
    return index.promises(wanted).count(), index.surviving(wanted, limit, **given).count()


def test_search_stops_early(spark, tmp_path, monkeypatch):
    """Blocks that cannot hold one of the best are passed over; results are those of all of them, ties and filters included."""
    monkeypatch.setattr(search.Index, "DOCUMENTS", 8)
    monkeypatch.setattr(search.Index, "FIRST", 4)
    texts = [(i, "common " * (1 + i % 3) + f"{'rare ' if i in (31, 400, 401) else ''}" + "fill " * (i % 9), "even" if i % 2 == 0 else None, f"p{i // 4}") for i in range(600)]
    docs = spark.createDataFrame([*texts, (900, None, "even", None), (901, "", None, "p0")], "id bigint, search_text string, kind string, path string")
    index = search.Index.write(docs, str(tmp_path / "i"), attributes=("kind", "path"), near="path")
    wanted = ["common", "rare"]
    n, read = blocks_of(index, wanted, 3)
    assert n > 50 and read <= n // 4
    covers = index._covers(index.surviving(wanted, 3))
    assert len(covers) <= index.RANGES + 1 and "GreaterThanOrEqual(block" in index.hits(wanted, index.surviving(wanted, 3))._jdf.queryExecution().executedPlan().toString()

    def brute(limit, kept=lambda r: True):
        t = {r[0]: r for r in texts}
        words_ = {k: r[1].split() for k, r in t.items()}
        mean, count = sum(map(len, words_.values())) / 602, 602
        df = {w: sum(w in x for x in words_.values()) for w in wanted}
        one = lambda x, w: math.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) if w in x else 0
        scores = [(-round(sum(one(x, w) for w in wanted), 6), k) for k, x in words_.items() if kept(t[k])]
        return [k for _, k in sorted(scores)[:limit]]

    ids = lambda limit, **given: [r.id for r in index.ranked("Common rare", limit, **given).collect()]
    for limit in (1, 3, 4, 50):
        assert ids(limit) == brute(limit)
    assert ids(7, where={"kind": "even"}) == brute(7, lambda r: r[2] == "even")
    assert ids(7, where={"path": "p100", "kind": "even"}) == brute(7, lambda r: r[3] == "p100" and r[2] == "even")
    assert ids(5, where={"kind": "none such"}) == []
    assert index.promises(wanted, {"path": "p100"}).count() < n // 4
    assert ids(3, keep=docs.where("id > 401").select("id")) == brute(3, lambda r: r[0] > 401)
    with pytest.raises(ValueError, match="no attribute"):
        index.ranked("rare", 1, where={"size": "1"})
    nothing = search.Index.write(docs.limit(0), str(tmp_path / "none"), attributes=("kind",))
    assert nothing.ranked("rare", 3).count() == 0 == nothing.ranked("rare", 3, where={"kind": "even"}).count()


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, "b a B b. a.b"), (2, None), (3, ""), (4, "x " * 50_000 + "y")]
    got = search.postings(spark.createDataFrame(rows, "id bigint, search_text string"))
    assert sorted((r.id, r.term, r.tf, r.length) for r in got.collect()) == [(1, "a", 1, 5), (1, "a.b", 1, 5), (1, "b", 3, 5), (4, "x", 50_000, 50_001), (4, "y", 1, 50_001)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_stream_starts_again(spark, tmp_path):
    from loamline.streaming import mutations

    put = lambda n, rows: spark.createDataFrame(rows, "k string, at int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    read = lambda: {r.k: r.v for r in mutations.follow(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema, "k", ("at",), str(tmp_path / "out")).collect()}
    put(0, [("a", 1, 1), ("b", 1, 1)])
    assert read() == {"a": 1, "b": 1} and read() == {"a": 1, "b": 1}  # the second run has no batch
    put(1, [("a", 2, 2), ("b", 0, 9)])
    assert read() == {"a": 2, "b": 1}


def test_query_limits():
    for bad in (("", 1), ("x" * 4097, 1), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            search.query_terms(*bad)


def test_git_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.md").write_text("# T\n")
    (tmp_path / "b").write_bytes(b"\x00\xff")
    (tmp_path / "l").symlink_to("a.md")
    run("add", "-A")
    run("commit", "-qm", "x")
    run("tag", "v1")
    run("tag", "-a", "v2", "-m", "y")
    commit, when = git.commit_of(str(tmp_path), "main")
    assert {r.commit for r in git.tags(spark, str(tmp_path)).collect()} == {commit} and "T" in when
    got = {r.path: (r.mode, bytes(r.content)) for r in git.tree(spark, str(tmp_path), commit).collect()}
    assert got == {"a.md": ("100644", b"# T\n"), "b": ("100644", b"\x00\xff"), "l": ("120000", b"a.md")}
    for bad in ("main~1", "HEAD^", "-x"):
        with pytest.raises(ValueError):
            git.commit_of(str(tmp_path), bad)
    assert preset()["mode"] == "syntax"


def test_command_line(spark, tmp_path, capsys):
    from loamline.__main__ import parser, run

    repo, root = tmp_path / "r", str(tmp_path / "c")
    repo.mkdir()
    g = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    do = lambda *a: run(spark, parser().parse_args(["--root", root, *a])).collect()
    g("init", "-q", "-b", "main")
    (repo / "a.md").write_text("# Needle\n\ntext\n")
    (repo / "b.bin").write_bytes(b"\x00")
    g("add", "-A")
    g("commit", "-qm", "1")
    g("tag", "v1")
    assert do("import", "--path", str(repo), "--dry-run")[0].asDict().items() >= {"included": 1, "excluded": 1}.items()
    first = do("import", "--path", str(repo), "--ref", "main")[0].commit
    (repo / "c.txt").write_text("more\n")
    g("add", "-A")
    g("commit", "-qm", "2")
    g("tag", "v2")
    row = do("import", "--path", str(repo), "--ref", "main", "--previous", first, "--dry-run")[0]
    assert (row.added, row.modified, row.unchanged) == (1, None, 2)
    assert {(r.ref, r.status) for r in do("sync-tags", "--path", str(repo))} == {("refs/tags/v1", "available"), ("refs/tags/v2", "pending")}
    do("import", "--path", str(repo), "--ref", "main", "--previous", first)
    assert len(do("versions")) == 2 and do("resolve", "v2")[0].commit != first
    assert do("search", "v1", "needle")[0].path == "a.md" and do("read", "v2", "a.md", "--lines", "1:1")[0].text == "# Needle\n"
    hit = do("search", "v1", "needle")[0]
    assert do("read", "--handle", hit.handle)[0].path == "a.md" and do("verify", "v2") == []
    with pytest.raises(ValueError):
        do("read", "v2", "a.md", "--handle", hit.handle)
    made = do("repo-add", "https://github.com/a/b", "--title", "B", "--tag", "k=v")[0]
    assert made.tags == {"k": "v"} and do("repo-list")[0].status == "ready"
    do("--repo", "a/b", "import", "--path", str(repo), "--ref", "v1")
    assert len(do("--repo", "B", "versions")) == 1
