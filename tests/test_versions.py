"""Publication as a log of attempts and segments: resuming, two writers, forks, what is written, and searches over segments."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loamline.operators import chunking, search, versions
from loamline.plans import segments
from loamline.plans.build import build
from loamline.plans.corpus import Corpus
from loamline.plans.log import Attempt, Conflict, Fenced, Log
from test_corpus import SOURCES, entries

COMMITS = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(20)]
WHEN = "2024-01-02T00:00:00+00:00"


def words(k, n=30):
    return " ".join(f"w{(k * 7 + i * i) % 50}" for i in range(n)) + "\n"


def tree(spark, changes=()):
    files = {**SOURCES, **{f"d/{k}.txt": words(k) for k in range(12)}}
    files.update(changes)
    return entries(spark, [(p, t) for p, t in files.items() if t is not None])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_records(corpus, commit, df):
    """A version holds what a build of its tree from nothing has."""
    fresh = build(df)
    for name in ("inventory", "files", "chunks"):
        assert rows(corpus.table(commit, name).select(*getattr(fresh, name).columns)) == rows(getattr(fresh, name))


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_log_numbers_are_made_once(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.state().number == 0 and log.append({"kind": "x"}, 0) == 1
    with pytest.raises(Conflict):
        log.append({"kind": "y"}, 0)
    (tmp_path / "log" / "000000000002.json").touch()  # its writer was lost before it wrote
    assert log.state().number == 2 and log.add(lambda s: {"kind": "z"})[0] == 3 and log.state().number == 3


PHASES = ["cut", "files", "index"]


def test_killed_publications_resume(spark, tmp_path, monkeypatch):
    """A writer that is lost after any phase leaves nothing to see; the next goes on behind it and cuts nothing again."""
    corpus, df, whole = Corpus(spark, str(tmp_path / "c"), "demo"), tree(spark), Attempt.phase
    done = []
    for last in PHASES:

        def phase(self, name, write):
            if name not in self.phases:
                done.append(name)
            at = whole(self, name, write)
            if name == last:
                raise KeyboardInterrupt(name)
            return at

        monkeypatch.setattr(Attempt, "phase", phase)
        with pytest.raises(KeyboardInterrupt, match=last):
            corpus.publish_tree(df, COMMITS[0], WHEN)
        assert corpus.versions().count() == 0 and len(set(done)) == len(done) and done[-1] == last
        monkeypatch.undo()

    def broken(mode, tokenizer):
        def run(batches):
            raise RuntimeError("cut again")
            yield

        return run

    monkeypatch.setattr(chunking, "_chunked", broken)
    tag = corpus.publish_tree(df, COMMITS[0], WHEN)
    monkeypatch.undo()
    assert corpus.versions().first().tag == tag and corpus.verify(COMMITS[0]).count() == 0 and corpus.log.sweep() == []
    same_records(corpus, COMMITS[0], df)
    assert corpus.publish_tree(df, COMMITS[0], WHEN) == tag and corpus.versions().count() == 1


def test_another_tree_takes_nothing_over(spark, tmp_path, monkeypatch):
    corpus, whole = Corpus(spark, str(tmp_path / "c"), "demo"), Attempt.phase

    def phase(self, name, write):
        at = whole(self, name, write)
        if name == "chunks":
            raise KeyboardInterrupt
        return at

    monkeypatch.setattr(Attempt, "phase", phase)
    with pytest.raises(KeyboardInterrupt):
        corpus.publish_tree(tree(spark), COMMITS[0], WHEN)
    monkeypatch.undo()
    other = tree(spark, {"new.md": "# other\n"})
    corpus.publish_tree(other, COMMITS[0], WHEN)
    same_records(corpus, COMMITS[0], other)
    left = corpus.log.sweep()
    assert len(left) == 1 and not os.path.exists(tmp_path / "c" / "data" / left[0]) and corpus.verify(COMMITS[0]).count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    corpus, own = Corpus(spark, str(tmp_path / "c"), "demo"), build(tree(spark))
    first = corpus._begin("main", COMMITS[0], own.config_hash, own.inventory)
    first.table("inventory", segments.keyed(own.inventory))
    second = corpus._begin("main", COMMITS[0], own.config_hash, own.inventory)
    assert second.phases == first.phases
    with pytest.raises(Fenced):
        corpus._publish(first, own, COMMITS[0], WHEN)
    assert corpus.versions().count() == 0
    corpus._publish(second, own, COMMITS[0], WHEN)
    assert corpus.versions().count() == 1 and corpus.verify(COMMITS[0]).count() == 0


def test_versions_write_what_changed(spark, tmp_path):
    """Segments with deletions, changes, a return of what was gone, and a merge; each version equals a build from nothing, in rows and in scores."""
    corpus = Corpus(spark, str(tmp_path / "c"), "demo")
    steps = [{}, {"d/1.txt": None, "doc.md": SOURCES["doc.md"] + "more\n"}, {"d/1.txt": words(1), "d/2.txt": words(2) + "x", "d/3.txt": None}]
    now = {}
    for k, step in enumerate(steps):
        now.update(step)
        df = tree(spark, now)
        if k == 1:
            corpus.publish(build(df), COMMITS[k], WHEN)
        else:
            corpus.publish_tree(df, COMMITS[k], WHEN)
        same_records(corpus, COMMITS[k], df)
        chunks = build(df).chunks
        fresh = search.Index.write(chunks, str(tmp_path / f"i{k}"))
        for q in ("w1 w14 heading", "w49"):
            assert [(h.id, h.score) for h in corpus.search(COMMITS[k], q, 50).collect()] == [(h.id, h.score) for h in fresh.ranked(q, 50).collect()]
        v = corpus.log.state().versions
        added = corpus.spark.read.parquet(f"{corpus.root}/data/{max(v.items())[1]['phases']['files']}").count()
        assert added == [len(SOURCES) + 12, 1, 2][k] and len(max(v.items())[1]["segments"]) == k + 1
    assert corpus.verify(COMMITS[0]).count() == 0  # earlier versions are as they were


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MOST", 2)
    corpus = Corpus(spark, str(tmp_path / "c"), "demo")
    for k in range(3):
        corpus.publish(build(tree(spark, {"n.txt": words(k), "d/1.txt": None if k else words(1)})), COMMITS[k], WHEN)
    assert [len(v["segments"]) for v in corpus.log.state().versions.values()] == [1, 2, 1]
    same_records(corpus, COMMITS[2], tree(spark, {"n.txt": words(2), "d/1.txt": None}))


def test_forks_copy_pointers(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), "demo")
    corpus.publish_tree(tree(spark), COMMITS[0], WHEN)
    before = size(tmp_path / "c" / "data")
    corpus.fork(COMMITS[0], "side")
    assert size(tmp_path / "c" / "data") == before
    with pytest.raises(ValueError):
        corpus.fork(COMMITS[0], "side")
    a, b = tree(spark, {"a.txt": "main only\n"}), tree(spark, {"b.txt": "side only\n"})
    corpus.publish_tree(a, COMMITS[1], WHEN)
    corpus.publish_tree(b, COMMITS[2], WHEN, branch="side")
    assert rows(corpus.branches().select("branch", "commit")) == [("main", COMMITS[1]), ("side", COMMITS[2])]
    same_records(corpus, COMMITS[1], a)
    same_records(corpus, COMMITS[2], b)
    held = corpus.log.state().versions
    assert len({v["segments"][0] for v in held.values()}) == 1 and sorted(len(v["segments"]) for v in held.values()) == [1, 2, 2]


def test_rows_are_named_by_all_that_they_say(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (None, "1", "a"), (1, None, "a")], "x int, y string, z string")
    got = [(r.k1_, r.k2_) for r in segments.keyed(df).collect()]
    assert len(set(got)) == 3 and got[0] == got[3]
    added, gone = segments.delta(segments.keyed(df.limit(2)), segments.keyed(df.where("x IS NULL OR y IS NULL")))
    assert [r.y for r in added.collect()] == ["a"] and [r.y for r in gone.collect()] == ["1"]


def test_matching_shuffles_only_names_that_are_asked(spark):
    """Without a selector that is a tag or no digits, a hex commit goes under its leading digits alone, and its tag is not carried along."""
    commits = [(f"{i:064x}"[::-1], f"ver-{i:040x}") for i in range(1, 40)] + [("release/one", "ver-x"), ("abcdef1" + "0" * 33, "abcdef2")]
    published = spark.createDataFrame(commits, "commit string, tag string")
    ask = lambda *s: sorted((r.selector, r.commit) for r in versions.matching(published, spark.createDataFrame([(x,) for x in s], "selector string")).collect())
    assert ask("abcdef1", commits[0][0], commits[1][0][:9]) == sorted([("abcdef1", commits[-1][0]), (commits[0][0],) * 2, (commits[1][0][:9], commits[1][0])])
    assert ask("release/one", "ver-x", commits[2][1], "release") == sorted([("release/one",) * 2, ("ver-x", "release/one"), (commits[2][1], commits[2][0])])
    assert ask("abcdef2", "abcdef") == [("abcdef2", commits[-1][0])]
    found = versions.matching(published, spark.createDataFrame([("abcdef1",)], "selector string")).groupBy("selector").agg(F.min("commit"))
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "tag#" not in above


def test_release_status_shuffles_packed_names(spark):
    """Names are packed before joins, and come out as they were, whatever they are."""
    odd = ["", "a", "abc", "AB" * 20, "ab" * 20, "ver-" + "0f" * 20, "rel-" + "0f" * 20, "rel-", "ver-0", "g" * 8, "\u00e9\u0000", None]
    back = spark.createDataFrame([(x,) for x in odd], "x string").withColumn("p", versions._packed(F.col("x"))).select("x", "p", versions._unpacked(F.col("p")).alias("y")).collect()
    assert all(r.x == r.y for r in back) and len({bytes(r.p) for r in back if r.p is not None}) == len(odd) - 1
    assert {len(r.p) for r in back if r.x in ("ver-" + "0f" * 20, "ab" * 20)} == {21}
    names = spark.createDataFrame([(f"r{k}", c, f"rel-{k}") for k, c in enumerate(["c1", "ab" * 20, "ab" * 20, None])], "ref string, commit string, alias string")
    published = spark.createDataFrame([("c1", "t1"), ("c1", "t1"), ("ab" * 20, "ver-" + "cd" * 20)], "commit string, tag string")
    aliases = spark.createDataFrame([("rel-0", "t1"), ("rel-1", "ver-" + "cd" * 20), ("rel-2", "ver-" + "CD" * 20)], "alias string, target string")
    got = sorted(map(tuple, versions.release_status(names, published, aliases).collect()))
    assert got == [("r0", "c1", "t1", "available"), ("r1", "ab" * 20, "ver-" + "cd" * 20, "available"), ("r2", "ab" * 20, "ver-" + "cd" * 20, "out-of-sync"), ("r3", None, None, "pending")]
