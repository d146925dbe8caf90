"""Git trees read by subtrees, and point look-ups on stored tables."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loamline.operators import lookup
from loamline.sources import git


def _repository(at):
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True).stdout
    run("init", "-q", "-b", "main")
    files = {"top.txt": b"top", "a/x.txt": b"x", "a/b/y.bin": b"\x00\xff", "a/b/c/z.txt": b"", "d/e.txt": "ö\n".encode(), "d/\tt\n.txt": b"t", "ab/w.txt": b"beside a"}
    for path, content in files.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(content)
    (at / "link").symlink_to("top.txt")
    run("add", "-A")
    run("commit", "-q", "-m", "one")
    (at / "top.txt").write_bytes(b"not committed")
    return run, {**files, "link": b"top.txt"}, run("rev-parse", "HEAD").decode().strip()


@pytest.mark.parametrize("subtrees", [1, 3, 64])
def test_trees_by_subtree(spark, tmp_path, subtrees):
    """However far the tree is split, its rows are those of one whole listing, each once."""
    run, files, commit = _repository(tmp_path)
    df = git.tree(spark, str(tmp_path), commit, subtrees=subtrees)
    got = df.collect()
    listed = [e.partition(b"\t") for e in run("ls-tree", "--full-tree", "-r", "-z", "-l", commit).split(b"\0")[:-1]]
    assert sorted((f"{r.mode} {r.type} {r.oid} {r.bytes}".split(), bytes(r.path_bytes)) for r in got) == sorted((h.decode().split(), p) for h, _, p in listed)
    assert {r.path: bytes(r.content) for r in got} == files and len(got) == len(files)


def test_a_folder_reads_only_its_subtree(spark, tmp_path):
    _, files, commit = _repository(tmp_path)
    df = git.tree(spark, str(tmp_path), commit, under="a/", content=False)
    assert df.columns == [c.split(" ")[0] for c in git.ENTRY.split(", ")] and {r.path for r in df.collect()} == {p for p in files if p.startswith("a/")}
    parts = git._TreeReader(str(tmp_path), commit, "a", False, 64).partitions()
    assert [(p.prefix, p.whole) for p in parts] == [(b"a/", False), (b"a/b/", False), (b"a/b/c/", False)]
    for bad in ("nowhere", "top.txt"):
        with pytest.raises((LookupError, subprocess.CalledProcessError)):
            git._TreeReader(str(tmp_path), commit, bad, True, 64).partitions()


def test_an_empty_tree(spark, tmp_path):
    run, _, _ = _repository(tmp_path)
    run("rm", "-q", "-r", "--cached", ".")
    run("commit", "-q", "--allow-empty", "-m", "none")
    assert git.tree(spark, str(tmp_path), run("rev-parse", "HEAD").decode().strip()).count() == 0


def _scanned(df):
    """Rows that a plan without adaptive execution took from parquet."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(k) for k in range(leaves.size())]
    return sum(x.metrics().apply("numOutputRows").value() for x in found if "parquet" in x.nodeName())


def test_look_ups_read_few_pages(spark, tmp_path):
    at, n = str(tmp_path / "t"), 40_000
    rows = spark.range(n).selectExpr("concat('k', id) AS key", "id AS v", "sha2(cast(id AS string), 256) AS body")
    lookup.write(rows, at, "key", group_bytes=1 << 18, page_rows=200)
    asked = spark.createDataFrame([("k7",), ("k39999",), ("absent",), (None,), ("k7",)], "key string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lookup.find(spark, at, asked, "key")
        got = sorted(((r.key or "", r.v, r.found) for r in df.collect()))
        rows = lookup.stored(spark, at, asked.distinct().withColumn(lookup.HASH, F.xxhash64("key"))).select("v")
        rows.collect()
        assert 0 < _scanned(rows) < n / 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == sorted([("", None, False), ("absent", None, False), ("k39999", 39999, True), ("k7", 7, True)])


def test_look_ups_of_many_keys_segments_and_repeats(spark, tmp_path):
    """A batch that touches every range, a hot key, an empty batch and an empty table, over two segments."""
    first = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id)) AS key", "id AS v")
    lookup.write(first, str(tmp_path / "a"), "key")
    lookup.write(spark.range(3000, 3100).selectExpr("IF(id = 3000, NULL, concat('k', id)) AS key", "id AS v"), str(tmp_path / "b"), "key")
    lookup.write(first.limit(0), str(tmp_path / "c"), "key")
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    asked = spark.range(0, 4000, 2).selectExpr("IF(id = 0, 'hot', IF(id = 2, NULL, concat('k', id))) AS key")
    got = sorted((r.key or "", r.v) for r in lookup.find(spark, both, asked, "key").collect())
    held = {}
    for v in range(3100):
        held.setdefault(None if v == 3000 else "hot" if v % 3 == 0 and v < 3000 else f"k{v}", []).append(v)
    keys = {"hot", None, *(f"k{v}" for v in range(4, 4000, 2))}
    assert got == sorted((k or "", v) for k in keys for v in (held.get(k, [None]) if k else [None]))
    assert lookup.find(spark, both, asked.limit(0), "key").count() == 0
    assert [r.found for r in lookup.find(spark, str(tmp_path / "c"), asked.limit(1), "key").collect()] == [False]
    with pytest.raises(ValueError):
        lookup.write(first.withColumn(lookup.HASH, first.v), str(tmp_path / "d"), "key")
