"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import comparable
from loamline.llm import decontaminate, jaccard_join, license_scan, lm_scoring, mixing, order_minhash, quality, queries, recompress, substring_dedup, token_counts, url_rules
from loamline.llm.common import Spans, hashed_words
from loamline.llm.components import components

CLASH = ["k_", "text_", "g_", "n_", "key_", "t", "c0_", "score", "n", "row_", "file_"]


def frame(spark, rows, *more):
    """doc_id, text, lang, source, n_chars, and columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), F.col("doc_id") % 3), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit("clash") for c in more})


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


BASE = words(1, 120)
ODD = [(1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two"), (8, BASE.replace("w1", "x1", 1)), (9, "a b " * 3000), (10, words(2, 30000)), (None, words(3, 60)), (None, None), (11, "Été 😀 " * 30), (12, "ha " * 100)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, *CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], *CLASH)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, oracle, name):
    df = queries.QUERIES[name](spark, data)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == oracle(queries.ORACLES[name], data, df.columns)


def docs_of(spark, data):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


# Quality classifier


def test_quality_ranks_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, data).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.fit(x, y, trees=30)
    assert ((trees.scores(x) > 0.5) == (y > 0)).mean() > 0.95
    for row, got in zip(x[:20], trees.scores(x[:20])):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        assert math.isclose(got, 1 / (1 + math.exp(-total)))
    assert quality.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5] and len(set(quality.fit(x, y * 0).scores(x))) == 1


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1), (5, 1)], "doc_id bigint, quality int")
    model = quality.train(odd, labels)
    rated = quality.scored(odd, model)
    assert rated.columns == [*[c for c in odd.columns if c != "score"], "score"] and rated.where("score BETWEEN 0 AND 1").count() == len(ODD)
    by_text = {(r.text or ""): r.score for r in rated.collect()}
    want = model.scores(quality.statistics([(t or "").encode() for _, t in ODD]))
    assert all(math.isclose(by_text[t or ""], x, rel_tol=1e-9) for (_, t), x in zip(ODD, want))
    assert quality.scored(empty, model, score="s").count() == 0 and quality.train(empty, labels).scores(np.zeros((1, len(quality.STATISTICS))))[0] == pytest.approx(0.5)


# N-gram Jaccard join


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 70)])
def test_components_match_all_pairs(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for g in range(12):
        base = words(100 + g, rng.choice([4, 12, 60, 150]))
        for _ in range(rng.randint(1, 14)):
            rows.append((len(rows), edited(base, rng, rng.randint(0, 4)) + (" the common closing line of many texts" if rng.random() < 0.4 else "")))
    rng.shuffle(rows)
    got = jaccard_join.grouped(frame(spark, rows, *CLASH), width=width, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, width, percent)


def test_components_of_all_sizes(spark):
    """Sets that differ by few shingles in size, at the very threshold: prefixes of different lengths must still meet."""
    rows = []
    for n in range(1, 60):
        for cut in {0, 1, max(1, n // 10), max(1, n // 5)} - {n}:
            rows.append((len(rows), " ".join(f"q{n}x{i}" for i in range(n - cut))))
    for percent in (90, 80, 50, 30):
        got = jaccard_join.grouped(frame(spark, rows), width=1, percent=percent).collect()
        assert sorted(map(tuple, got), key=repr) == brute_components(rows, 1, percent)


def test_components_edges(spark, odd, empty):
    got = sorted(map(tuple, jaccard_join.grouped(odd).collect()), key=repr)
    assert got == brute_components(ODD, 5, 80)
    assert jaccard_join.grouped(empty).count() == 0
    kept = [r.doc_id for r in jaccard_join.representatives(odd).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 8 not in kept and {3, 4, 5, 6, 7} <= set(kept)


def test_hot_groups_meet_once(spark, monkeypatch):
    """Classes of one component never meet by a shingle of theirs, however many have it, and links across components are found."""
    known = [("t", i, 100, 0, 1) for i in range(20_000)] + [("t", 20_000 + i, 100, 0, 2) for i in range(3)] + [("u", 5, 100, 0, 1), ("u", 6, 100, 0, 1), ("v", 7, 100, 90, 1), ("v", 20_001, 100, 0, 2)]
    known = spark.createDataFrame(known, "token string, node bigint, n bigint, at bigint, c bigint")
    across = jaccard_join._across(known, 80)
    assert across.count() == 3 * 20_000
    base = words(31, 80).split()
    near = [(i, " ".join([*base[: i % 7], f"x{i}", *base[i % 7 :]])) for i in range(1500)]
    far = [(5000 + i, " ".join([*base[:72], *[f"y{i}z{j}" for j in range(8)]])) for i in range(3)]
    got = jaccard_join.grouped(frame(spark, near + far), width=1, percent=80).collect()
    sets = {k: set(t.split()) for k, t in near + far}
    linked = lambda a, b: len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])
    assert {r.component_id for r in got if r.doc_id < 5000} == {0}
    for k, _ in far:
        want = 0 if any(linked(k, i) for i in range(1500)) else min(j for j, _ in far if j == k or linked(j, k))
        assert next(r.component_id for r in got if r.doc_id == k) == want


def test_stars_follow_long_chains(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(300, 301), (301, 300), (7, 7)]
    names = list(range(400))
    rng.shuffle(names)
    got = {r.node: r.component for r in components(spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a bigint, b bigint")).collect()}
    for group in (range(0, 61), range(100, 160), (300, 301)):
        assert {got[names[x]] for x in group} == {min(names[x] for x in group)}


# Licence scan


def test_licences(spark, empty):
    t = queries.LICENCES
    rows = [
        (1, "r/LICENSE", t["MIT"] + "\n"), (2, "r/a/x.c", "code"), (3, "r/a/b/COPYING.txt", "Intro\n" + t["GPL-3.0"]), (4, "r/a/b/y.c", None), (5, "r/a/b/c/z.c", "// " + t["Apache-2.0"]), (6, "q/w.c", ""), (7, None, t["MIT"]), (8, "top.c", "x"),
        (9, "r/ab/v.c", "licensed premises mit der und"), (10, "r/a/b/c/u.c", "nothing here"), (10, "r/a/b/c/u.c", "nothing here"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumns({c: F.lit("clash") for c in ("file_", "licence", "cosine", "line", "dir_", "at")})
    got = sorted((r.doc_id, r.own_licence, r.inherited_from, r.licence) for r in license_scan.scan(df, t).collect())
    assert got == [
        (1, "MIT", None, "MIT"), (2, None, "r", "MIT"), (3, "GPL-3.0", None, "GPL-3.0"), (4, None, "r/a/b", "GPL-3.0"), (5, "Apache-2.0", None, "Apache-2.0"), (6, None, None, None), (7, "MIT", None, "MIT"), (8, None, None, None), (9, None, "r", "MIT"),
        (10, None, "r/a/b", "GPL-3.0"), (10, None, "r/a/b", "GPL-3.0"),
    ]
    assert license_scan.scan(empty.withColumn("path", F.lit("a/b")), t).count() == 0


def test_wrapped_licences(spark):
    """Notices wrapped over several lines, of which none reaches the threshold alone, count as blocks and as whole files."""
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "Redistributions of source code must retain the above copyright notice.\n\nRedistributions in binary form must reproduce this list of conditions\nin the documentation and other materials.\n\nNeither the name of the holder nor the names of its contributors may\nendorse products derived from this software without permission."
    t = {"GPL-3.0": gpl.replace("\n", " "), "BSD-3-Clause": bsd.replace("\n", " ")}
    star = lambda x: "/*\n" + "\n".join(f" * {y}" for y in x.split("\n")) + "\n */\n"
    rows = [
        (1, "r/a/x.c", star(gpl) + "int a;\n" * 50), (2, "r/a/y.py", "\n".join(f"# {y}" for y in bsd.split("\n")) + "\nimport os\n" * 50), (3, "r/b/LICENSE", bsd), (4, "r/b/z.c", "int b;\n"),
        (5, "r/c/w.txt", "code\n\n" + gpl + "\n\nmore code\n"), (6, "r/c/v.txt", "free\nsoftware\n"), (7, "r/d/u.c", "/*\n" + bsd + "\n*/ int c;\n" * 50), (8, "r/e/s.txt", gpl.split("\n")[3]),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.own_licence, r.inherited_from, r.licence) for r in license_scan.scan(df, t, least=0.8).collect()}
    g, b = "GPL-3.0", "BSD-3-Clause"
    assert got == {1: (g, None, g), 2: (b, None, b), 3: (b, None, b), 4: (None, "r/b", b), 5: (g, None, g), 6: (None, None, None), 7: (b, None, b), 8: (None, None, None)}


def test_licence_cosines_match_all_lines(spark, data):
    docs, t = docs_of(spark, data), queries.LICENCES
    split = lambda s: __import__("re").findall(r"[^\W_]+", s.lower())
    held = Counter(w for _, x in docs for w in set(split(x)))
    n = len(docs)
    known = {w for s in t.values() for w in split(s)}
    idf = lambda w: math.log((n + 1) / ((held[w] if w in known else 0) + 1)) + 1
    vector = lambda s: {w: c * idf(w) for w, c in Counter(split(s)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {name: vector(s) for name, s in t.items()}
    want = {}
    for k, x in docs:
        best = max(((sum(v.get(w, 0) * x_ for w, x_ in line.items()) / (norm(v) * norm(line)), name) for line in map(vector, x.split("\n")) if line for name, v in own.items()), key=lambda p: (round(p[0], 9), [-ord(c) for c in p[1]]), default=(0, ""))
        if round(best[0], 9) >= 0.6:
            want[k] = (best[1], round(best[0], 6))
    got = {r.doc_id: (r.own_licence, round(r.cosine, 6)) for r in queries.op3_license_scan(spark, data).where("own_licence IS NOT NULL").collect()}
    assert got == want and want


# Substring dedup


def brute_repeats(rows, window):
    seen, out = {}, []
    texts = [(k, i, (t or "").encode().split()) for i, (k, t) in enumerate(rows)]
    order = lambda k: -math.inf if k is None else k
    for k, _, w in texts:
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            seen[g] = min(seen.get(g, (math.inf, 0)), (order(k), p))
    for k, _, w in texts:
        gone, own = [False] * len(w), set()
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            if seen[g][0] != order(k) or g in own:
                gone[p : p + window] = [True] * window
            own.add(g)
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        out.append((k, len(w), sum(gone), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 5])
def test_repeats_match_all_windows(spark, window):
    rng = random.Random(window)
    passages = [words(i, rng.randint(window - 2, 70)) for i in range(8)]
    rows = []
    for k in range(60):
        parts = [words(1000 + k * 10 + j, rng.randint(0, 60), 50 if k % 5 else 3) for j in range(3)]
        rows.append((k, " ".join(parts[:1] + [rng.choice(passages)] * (k % 3) + parts[1:])))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rng.shuffle(rows)
    got = substring_dedup.without_repeats(frame(spark, rows, *CLASH), window=window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, window)


def test_repeats_edges(spark, odd, empty):
    done = substring_dedup.without_repeats(odd)
    assert done.columns == [*odd.columns, "n_words", "n_removed", "kept_text"]
    assert sorted(map(tuple, done.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == brute_repeats(ODD, 20)
    assert substring_dedup.without_repeats(empty).count() == 0


def test_rows_of_one_key_are_not_gathered(spark, monkeypatch):
    """With one key on most rows, each row has its own ranges, and whole texts do not multiply."""
    passage = words(70, 40)
    rows = [(None if i % 4 else i, words(5000 + i, 50) + (" " + passage if i % 2 else "")) for i in range(80)] + [(None, words(5001, 50))] * 3
    docs = frame(spark, rows)
    tables = {}
    got = substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 20)
    monkeypatch.setattr(jaccard_join, "written", lambda df, name, write=jaccard_join.written: tables.setdefault(name, write(df, name)))
    near = [(None, t.replace("w2", "x2", 1)) for _, t in rows]
    copies = frame(spark, rows + near)
    assert sorted(map(tuple, jaccard_join.grouped(copies).collect()), key=repr) == brute_components(rows + near, 5, 80)
    stay = tables["jaccard-stay"]
    assert {"key_", "t_"} <= set(stay.columns) and stay.count() == stay.select("key_", "t_").distinct().count()


def test_next_cuts_a_hot_key(spark):
    """Rows of one key are dealt to many ranges, and each still has the row after it."""
    rows = spark.createDataFrame([(7 if i % 3 else i, f"text {i}") for i in range(3000)], "doc_id bigint, t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = order_minhash.with_next(rows, "doc_id", "t")
        sizes = out.groupBy(F.spark_partition_id()).count().select("count").toArrow()["count"].to_pylist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.t: r.next_t for r in out.collect()}
    assert len(got) == 3000 and max(sizes) < 1900
    at, seen = "text 0", set()
    while at not in seen:
        seen.add(at)
        at = got[at]
    assert len(seen) == 3000


@pytest.mark.parametrize("vocabulary", [2, 4, 50, 5000])
def test_repeated_windows_stay_open(vocabulary):
    """Rounds named by their own counts: no window that stands twice is closed, and symbols inside equal windows are equal."""
    rng = random.Random(vocabulary)
    texts = [[rng.randrange(vocabulary) + 1 for _ in range(rng.choice([0, 5, 15, 300, 2000]))] for _ in range(12)]
    for _ in range(40):
        a, b = rng.choice(texts), rng.choice(texts)
        at = rng.randrange(max(1, len(a) - 60))
        b[rng.randrange(len(b) + 1) : 0] = a[at : at + rng.randint(15, 60)]
    starts = np.cumsum([0, *map(len, texts)])
    w = np.concatenate([np.zeros(0, np.uint64), *[np.array(t, np.uint64) for t in texts]]) * np.uint64(0x9E3779B97F4A7C15)
    parse = recompress.Parse(*np.unique(w, return_inverse=True), starts, 20)
    places = np.flatnonzero(parse.open)
    counts = Counter(w[p : p + 20].tobytes() for p in places)
    repeated = [p for p in places if counts[w[p : p + 20].tobytes()] > 1]
    assert repeated
    for k in range(recompress.ROUNDS + 1):
        codes, n = parse.asked(k)
        parse.named(np.where(n > 1, hashed_words([b"%d:%d" % (k, i) for i in range(len(codes))])[0], np.uint64(0)))
        assert parse.open[repeated].all()
        inside = defaultdict(set)
        for p in repeated:
            held = (parse.low >= p) & (parse.high <= p + 20)
            inside[w[p : p + 20].tobytes()].add((tuple(parse.name[held]), tuple(parse.low[held] - p)))
        assert all(len(x) == 1 for x in inside.values())
    if vocabulary == 5000:
        assert parse.open.sum() < len(repeated) + 800  # some at each end of the 40 passages


# Order MinHash


def brute_fingerprint(spark, texts):
    """The same signature from k-mers, occurrence numbers and slots spelled out; hashes are Spark's."""
    ask = spark.createDataFrame([(i, j, *x) for i, t in enumerate(texts) for j, x in enumerate(kmers(t))], "i int, j int, a string, b string, c string")
    h = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64(F.struct("a", "b", "c")))
    return {(r.i, r.j): r.h for r in ask.select("i", "j", h.alias("h")).collect()}


def kmers(t):
    w = t.split()
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [(" ".join(w), None, None)] if w else []


def test_fingerprint_selects_by_occurrence_and_order(spark):
    texts = [words(4, 300, 30), words(5, 40), "a b", "a", "x y z x y z x y z", words(6, 2000, 5)]
    packed = brute_fingerprint(spark, texts)
    rehash = lambda pairs: {tuple(r[:2]): r[2] for r in spark.createDataFrame(sorted(pairs), "h bigint, n int").select("h", "n", F.xxhash64("h", "n")).collect()}
    numbered, todo = [], set()
    for i, t in enumerate(texts):
        counts, own = Counter(), []
        for j in range(len(kmers(t))):
            h = packed[i, j] >> order_minhash.PLACE_BITS
            counts[h] += 1
            own.append((h, counts[h], j))
            todo |= {(h, counts[h])} if counts[h] > 1 else set()
        numbered.append(own)
    again = rehash(todo)
    want = []
    for own in numbered:
        slots = defaultdict(list)
        for h, n, j in own:
            h = again[h, n] >> order_minhash.PLACE_BITS if n > 1 else h
            slots[(h % (1 << 64 - order_minhash.PLACE_BITS)) >> 59 - order_minhash.PLACE_BITS].append((h, j))
        want.append({s: [h for h, _ in sorted(sorted(x)[:2], key=lambda p: p[1])] for s, x in slots.items()})
    folded = spark.createDataFrame([(i, s, x) for i, w in enumerate(want) for s, x in w.items()], "i int, s bigint, x array<bigint>").select("i", "s", F.shiftrightunsigned(F.xxhash64("x"), 5).alias("f")).collect()
    expected = defaultdict(set)
    for r in folded:
        v = (r.s << 59) | r.f
        expected[r.i].add(v - (1 << 64) if v >= 1 << 63 else v)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", order_minhash.fingerprint(F.col("t")).alias("f")).collect()
    assert {r.i: set(r.f) for r in got} == expected


def test_fingerprint_of_repeats_costs_what_other_words_do(spark):
    """Numbering is linear in the repeats of a k-mer, runs of several k-mers at once included."""
    def took(word):
        at = time.monotonic()
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80_000)), word), " ")
        f = spark.range(1).select(order_minhash.fingerprint(text).alias("f")).first().f
        return len(f), time.monotonic() - at

    took(lambda i: i.cast("string"))  # plans and compiles
    distinct, base = took(lambda i: i.cast("string"))
    for word in (lambda i: F.lit("w"), lambda i: F.pmod(i, F.lit(7)).cast("string")):
        n, seconds = took(word)
        assert n == distinct == 32 and seconds < 2 * base + 5


def test_edited_likeness(spark, data, odd, empty):
    docs = sorted(docs_of(spark, data))
    got = {r.doc_id: r for r in queries.op5_order_minhash(spark, data).collect()}
    for i, (k, t) in enumerate(docs):
        q = len(t) // 4
        e = t[: len(t) - q] + docs[(i + 1) % len(docs)][1][:q]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1.0)
        slots = lambda f: {int(x, 16) for x in f.split(".") if x}
        for near, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, got[docs[(i + 1) % len(docs)][0]].fingerprint)):
            a, b = slots(r.fingerprint), slots(other)
            filled = {x >> 59 for x in a | b}
            assert math.isclose(near, len(a & b) / len(filled) if filled else 1.0)
    long_ = [got[k] for k, t in docs if len(t) > 400]
    assert sum(r.near_edited > r.near_next for r in long_) / len(long_) > 0.98
    rows = order_minhash.with_edited_likeness(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert order_minhash.with_edited_likeness(empty).count() == 0


def test_places_leave_hashes_alone(spark, monkeypatch):
    """Places fill their bits only, up to the longest array; more of them than their bits would change hashes."""
    assert 2**order_minhash.PLACE_BITS > 2**31 - 1
    ends = spark.createDataFrame([(h, p) for h in (-(2**63), -1, 0, 2**63 - 1) for p in (0, 2**24, 2**24 + 1, 2**31 - 1)], "h bigint, p bigint")
    kept = order_minhash._packed(F.col("h"), F.col("p"))
    got = ends.select("h", "p", order_minhash._hash(kept).alias("x"), kept.bitwiseAND(2**order_minhash.PLACE_BITS - 1).alias("y")).collect()
    assert all(r.x == r.h >> order_minhash.PLACE_BITS and r.y == r.p for r in got)
    w = words(21, 600, 3000).split()
    near = order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b")))
    one = spark.createDataFrame([(" ".join(w), " ".join([*w, "more"]))], "a string, b string").select(near).first()[0]
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 10)  # 600 words fit
    near = order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b")))
    assert one > 0.9 and spark.createDataFrame([(" ".join(w), " ".join([*w, "more"]))], "a string, b string").select(near).first()[0] > 0.9


def test_order_changes_the_fingerprint(spark):
    w = words(8, 400, 5000).split()
    rows = [(0, " ".join(w)), (1, " ".join(w[200:] + w[:200])), (2, " ".join(sorted(w)))]
    f = order_minhash.fingerprint(F.col("text"))
    pairs = frame(spark, rows).select("doc_id", f.alias("f"))
    near = pairs.alias("a").join(pairs.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", "b.doc_id", order_minhash.likeness(F.col("a.f"), F.col("b.f"))).collect()
    near = {(r[0], r[1]): r[2] for r in near}
    assert near[0, 2] < 0.1 and 0.3 < near[0, 1] < 1


def test_filled_slots(spark):
    """Every slot, against the ring of sorted k-mers; a slot that has enough of its own is as without filling."""
    texts = [words(4, 300, 30), words(5, 40), "a b", "a", "x y z x y z x y z", words(6, 12), words(7, 3000, 900), "", " "]
    f = lambda **options: order_minhash.fingerprint(F.col("t"), **options).alias("f")
    of = lambda texts, **options: [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(**options)).orderBy("i").collect()]
    slot = lambda x: (x % (1 << 64)) >> 59
    plain, filled = of(texts), of(texts, fill=True)
    lone = of(texts, slot_bits=5, keep=1)
    for t, p, q, one in zip(texts, plain, filled, lone, strict=True):
        assert sorted(map(slot, q)) == (list(range(32)) if t.split() else [])
        assert {slot(x) for x in p} == {slot(x) for x in one}
    assert set(plain[6]) == set(filled[6])  # every slot has two k-mers
    # With one k-mer a slot, an empty slot has what the next filled one has.
    low = lambda x: x % (1 << 59)
    for p, q in zip(lone, of(texts, keep=1, fill=True), strict=True):
        held = {slot(x): low(x) for x in p}
        for x in q:
            s = next(s % 32 for s in range(slot(x), slot(x) + 32) if s % 32 in held)
            assert low(x) == held[s]
    # With two, a slot of one k-mer and a slot of none: tuples of neighbours in the ring, in text order.
    h = lambda xs: spark.createDataFrame([(list(xs),)], "x array<bigint>").select(F.shiftrightunsigned(F.xxhash64("x"), 5)).first()[0]
    t = texts[5]
    own = sorted((v >> order_minhash.PLACE_BITS, j) for (_, j), v in brute_fingerprint(spark, [t]).items())
    assert len({x for x, _ in own}) == len(own)
    place = lambda x: (x % (1 << 33)) >> 28
    ring = sorted(own, key=lambda p: p[0] % (1 << 33)) * 2
    for x in filled[5]:
        i = next((i for i, p in enumerate(ring[: len(own)]) if place(p[0]) >= slot(x)), len(own))
        assert low(x) == h([v for v, _ in sorted(ring[i : i + 2], key=lambda p: p[1])])


def test_order_changes_fingerprints_of_short_texts(spark):
    """Halves swapped: slots that are filled tell short texts apart by order, about as they do long ones."""
    rows = []
    for i in range(120):
        w = words(100 + i, (12, 24, 36, 60)[i % 4], 5000).split()
        rows.append((len(w), " ".join(w), " ".join(w[len(w) // 2 :] + w[: len(w) // 2])))
    f = lambda c, fill: order_minhash.fingerprint(F.col(c), fill=fill)
    near = lambda fill: order_minhash.likeness(f("a", fill), f("b", fill))
    df = spark.createDataFrame(rows, "n int, a string, b string").select("n", near(False).alias("plain"), near(True).alias("filled"))
    got = {r.n: r for r in df.groupBy("n").agg(F.avg("plain").alias("plain"), F.avg("filled").alias("filled")).collect()}
    print({n: (round(r.plain, 2), round(r.filled, 2)) for n, r in sorted(got.items())})
    assert got[12].filled < 0.4 and all(r.filled < 0.6 for r in got.values()) and all(got[n].filled < got[n].plain - 0.1 for n in (12, 24, 36))


# Mixing


def pour(children, budget):
    """Shares by weight, with shortages handed on until nothing changes."""
    given, open_ = {c: 0.0 for c in children}, {c for c, (w, cap) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] - given[c] <= left * children[c][0] / total + 1e-12}
        if not full:
            for c in open_:
                given[c] += left * children[c][0] / total
            break
        for c in full:
            left -= children[c][1] - given[c]
            given[c] = children[c][1]
        open_ -= full
    return given


def test_budgets_pour_by_weight(spark):
    rng = random.Random(2)
    leaves = [(f"d{d}", lang, f"s{s}", rng.choice([0, 5, 100, 1000, 5000])) for d in range(3) for lang in ("en", "de", None) for s in range(4)]
    weights = [("d0", None, None, 5.0), ("d1", None, None, 1.0), ("d0", "en", None, 3.0), ("d1", "de", "s1", 0.0), ("d1", "de", "s2", 7.0)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    total = int(sum(x[3] for x in leaves) * 0.7)
    got = {tuple(r[:3]): r.budget for r in mixing.leaf_budgets(table, spark.createDataFrame(weights, "domain string, lang string, source string, weight double"), total, 2).collect()}
    w = lambda *p: next((x[3] for x in weights if x[:3] == tuple([*p, None, None][:3])), 1.0)
    cap = lambda *p: sum(2 * x[3] for x in leaves if x[: len(p)] == p)
    domains = pour({d: (w(d), cap(d)) for d in {x[0] for x in leaves}}, total)
    for d in domains:
        langs = pour({v: (w(d, v) if v else 1.0, cap(d, v)) for v in {x[1] for x in leaves}}, domains[d])
        for v in langs:
            for s, b in pour({x[2]: (w(d, v, x[2]) if v else 1.0, cap(d, v, x[2])) for x in leaves if x[:2] == (d, v)}, langs[v]).items():
                assert abs(got[d, v, s] - b) <= 4
    assert sum(got.values()) <= total and sum(got.values()) >= total - 40


def test_mix_takes_a_seeded_prefix_of_each_leaf(spark, data, odd, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = mixing.mix(docs, share=0.5, max_epochs=2)
    rows = out.collect()
    supply = Counter()
    for r in docs.collect():
        supply[r.lang, r.source] += len((r.text or "").split())
    taken, parts = Counter(), defaultdict(list)
    for r in rows:
        assert r.mix_tokens == len(r.text.split()) and r.mix_taken == r.mix_epochs * r.mix_tokens + r.mix_part and 0 <= r.mix_part <= r.mix_tokens
        taken[r.lang, r.source] += r.mix_taken
        parts[r.lang, r.source].append(r)
    assert 0 <= int(sum(supply.values()) * 0.5) - sum(taken.values()) <= 2 * len(supply)
    for leaf, own in parts.items():
        assert taken[leaf] <= 2 * supply[leaf] and len({r.mix_epochs for r in own}) == 1
        assert sum(0 < r.mix_part < r.mix_tokens for r in own) <= 1  # one document at the cut
    again = mixing.mix(docs.repartition(7), share=0.5, max_epochs=2).collect()
    key = lambda rs: sorted((r.doc_id, r.mix_taken) for r in rs)
    assert key(rows) == key(again) and key(rows) != key(mixing.mix(docs, share=0.5, max_epochs=2, seed=8).collect())
    assert mixing.mix(odd, share=1.0, max_epochs=1).where("mix_tokens > 0").count() == sum(bool((t or "").split()) for _, t in ODD)
    assert mixing.mix(empty).count() == 0


def test_mix_keeps_its_budget_without_keys(spark, monkeypatch):
    """Null keys, rows that are all alike, and a leaf whose ranges are refined to the last bits: never over budget, and short by less than a row."""
    kinds = {"null keys": [(None, f"a{i} " * 10) for i in range(100)], "one row": [(5, "b c d e f g h i j k")] * 100, "no words": [(None, " ")] * 5 + [(1, None)]}
    for edge in (1000, 1):
        monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
        for rows in kinds.values():
            taken = [(r.mix_part, r.mix_taken, r.mix_tokens) for r in mixing.mix(frame(spark, rows, "mix_part", "spot", "whole", "range"), share=0.555, max_epochs=1, source="lang").collect()]
            budget = int(sum(len((t or "").split()) for _, t in rows) * 0.555)
            assert budget - 100 < sum(x[1] for x in taken) <= budget and all(x[0] <= x[2] for x in taken)


# Token counts


def test_token_counts_match_whole_texts(spark, data, odd, empty):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r, (k, t) in zip(sorted(queries.op7_token_counts(spark, data).collect()), sorted(docs_of(spark, data))):
        n = len(model.encode(t))
        assert tuple(r) == (k, len(t.encode()), n, n > 4096)
    rng = random.Random(1)
    strange = ["".join(rng.choice([" ", "  ", "a", "Zz", "\n", "\t", "▁", "é", "😀", "<s>", "</s>", "<unk>", "　", ".", "12", "\x00"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    counter = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.batch([t.encode() for t in strange]).tolist() == [len(model.encode(t)) for t in strange]
    got = token_counts.count_tokens(odd, "piece_bpe_32k.model").collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), len(model.encode(t or ""))) for _, t in ODD)
    assert token_counts.count_tokens(empty, "piece_bpe_32k.model").count() == 0


# LM scoring


def test_lm_base_and_backoff(spark, data, odd, empty):
    docs = docs_of(spark, data)
    side = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    token = lambda t: [*[w.lower() for w in t.encode().split()], None]
    c = Counter(w for k, t in docs if not side(k) for w in token(t))
    total, base = sum(c.values()), sum(c.values()) + len(c) + 1
    gain = 0.0
    for r in queries.op8_lm_scoring(spark, data).collect():
        t = token(dict(docs)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (side(r.doc_id), len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / base) for w in t), rel_tol=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0
    assert lm_scoring.score(odd, odd).count() == len(ODD)
    assert lm_scoring.score(empty, empty).count() == 0 and {r.score for r in lm_scoring.score(odd, empty).collect()} == {0.0}


def test_lm_is_a_distribution_and_walks_like_recursion():
    rng = random.Random(4)
    text = [rng.choice([0, 0, 1, 2, 3, 4]) for _ in range(4000)]
    counts = np.array([text.count(w) for w in range(5)])
    start = 5
    pairs, triples = Counter(), Counter()
    for a, b, w in zip([start, start, *text], [start, *text], text):
        pairs[b, w] += 1
        triples[a, b, w] += 1
    pairs = {p: n for p, n in pairs.items() if n > 150}
    triples = {(a, b, w): n for (a, b, w), n in triples.items() if n > 40 and (a, b) in pairs and (b, w) in pairs}
    m = lm_scoring.Automaton(np.arange(5, dtype=np.uint64), counts, int(counts.sum()), 5, 100, pairs, triples)
    unknown = 1 / m.base

    def p_pair(h, w):
        own = (counts[w] + 1) / m.base
        if (h, w) in pairs:
            return (pairs[h, w] - lm_scoring.DISCOUNT) / [*counts, 100][h]
        return 10 ** m.backoff[h] * own

    def p(a, b, w):
        if (a, b) not in pairs:
            return p_pair(b, w)
        if (a, b, w) in triples:
            return (triples[a, b, w] - lm_scoring.DISCOUNT) / pairs[a, b]
        return 10 ** m.backoff[m.state_of[a, b]] * p_pair(b, w)

    for b in range(5):
        left = 10 ** m.backoff[b] * unknown
        assert math.isclose(sum(p_pair(b, w) for w in range(5)) + left, 1, rel_tol=1e-6)
        for a in range(5):
            left2 = left if (a, b) not in pairs else 10 ** m.backoff[m.state_of[a, b]] * left
            assert math.isclose(sum(p(a, b, w) for w in range(5)) + left2, 1, rel_tol=1e-6)
    some = text[:50]
    want = sum(math.log10(p(a, b, w) if i else p_pair(start, w)) for i, (a, b, w) in enumerate(zip([start, start, *some], [start, *some], some)))
    assert math.isclose(m.walk(some), want, rel_tol=1e-9)


def test_lm_keeps_rare_ngrams_of_large_corpora(spark):
    """Whatever the size of the corpus, n-grams seen twice are arcs: scores are those of the whole automaton in memory."""
    rng = random.Random(12)
    rare = [" ".join(f"{a}{rng.randrange(40)}" for a in "pqrstuv") for _ in range(60)]
    rows = [(i, "ha " * 20000) for i in range(20)] + [(100 + i, rare[i // 2] + f" only{i}") for i in range(120)] + [(300, words(3, 300, 20)), (301, None), (302, "Never Seen " + rare[0])]
    texts = {k: [*(t or "").lower().split(), ""] for k, t in rows}
    train = {k: t for k, t in texts.items() if k != 302}
    counts = Counter(w for t in train.values() for w in t)
    number = {w: i for i, w in enumerate(counts)}
    pairs, triples = Counter(), Counter()
    for t in train.values():
        x = [len(number), *(number[w] for w in t)]
        pairs.update(zip(x, x[1:]))
        triples.update(zip(x, x[1:], x[2:]))
    kept = [{g: n for g, n in c.items() if n >= 2} for c in (pairs, triples)]
    total = sum(counts.values())
    m = lm_scoring.Automaton(np.arange(len(number), dtype=np.uint64), np.array(list(counts.values())), total, len(number), len(train), *kept)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in lm_scoring.score(docs, docs.where("doc_id <> 302")).collect()}
    flagged = {r.doc_id: r for r in lm_scoring.score_rows(docs, F.col("doc_id") != 302, F.lit(True)).collect()}
    assert set(got) == set(flagged) == set(texts)
    for k, t in texts.items():
        want = m.walk([number.get(w, -1) for w in t]) - math.log10(m.base) * sum(w not in number for w in t)
        assert math.isclose(got[k].score, want, rel_tol=1e-9) and math.isclose(flagged[k].score, want, rel_tol=1e-9)
        assert got[k].train_tokens == total and got[k].n_known == sum(w in number for w in t)
    assert got[100].score > got[100].base_score + 5


# Decontamination


def test_leaks_match_exact_containment(spark, odd, empty):
    rng = random.Random(6)
    items = [(i, words(50 + i, rng.choice([2, 5, 6, 9, 20, 60, 200]), 3000)) for i in range(40)] + [(90, ""), (91, None), (92, words(50, 200)), (92, words(50, 200))]
    rows = []
    for k in range(80):
        t = rng.choice(items)[1] or ""
        rows.append((k, " ".join([words(500 + k, rng.randint(0, 400), 3000), edited(t, rng, rng.randint(0, 3)) if t else "", words(900 + k, 50, 3000)])))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for k, t in rows:
        for i, x in items:
            w = (x or "").split()
            if n := min(5, len(w)):
                s = grams(w, n)
                both = len(s & grams(t.split(), n))
                if both * 10 >= len(s) * 8:
                    want.append((k, i, len(s), both))
    got = decontaminate.leaks(frame(spark, rows, *CLASH), table).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want) and want
    kept = {r.doc_id for r in decontaminate.without_leaks(frame(spark, rows, *CLASH), table).collect()}
    assert kept == {k for k, _ in rows} - {x[0] for x in want}
    assert decontaminate.leaks(odd, table).count() >= 0 and decontaminate.leaks(empty, table).count() == 0
    assert decontaminate.without_leaks(odd, table.limit(0)).count() == len(ODD)


# URL rules


def test_url_rules(spark):
    urls = [
        "http://a.Example.com/en/7x", "https://example.com/en/8", "x", None, "://", "http://com/en/", "http://notcom/en/", "http://x.example.net/de/8?q", "http://x.example.net/de/9#f", "http://b.org", "http://b.org/es/", "http://a..com/en/1",
        "http://" + "a." * 3000 + "com/en/2", "http://h/" + "p" * 50000, "http://x.com/en/7", "http://x.com/en/7",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "u_key", "r_fit")})
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = __import__("re").match(r"[^/?#]*", rest).group()
        path = __import__("re").match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    got = url_rules.judge(df, rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *plain(u)) for i, u in enumerate(urls)]
    assert url_rules.judge(df.limit(0), rules).count() == 0 and url_rules.judge(df, rules.limit(0)).count() == len(urls)


def test_url_rules_of_many_shapes(spark):
    """5,000 shapes and 100,000 rules; letters beyond A-Z; no expression is null, so no key is hot."""
    rules = [(".".join(["x"] * (i % 50) + ["com"]), "/" + "p" * (i // 50), "block" if i % 2 else "allow") for i in range(5000)] + [("É.com", "/x", "block"), ("Z.com", "/", "block")] + [(f"h{i}.org", "/", "block") for i in range(95_000)]
    urls = [".".join(["x"] * n + ["com"]) + "/" + "p" * m for n, m in ((0, 0), (49, 99), (49, 200), (60, 5), (3, 98))] + ["É.com/x", "é.com/x", "z.com/q", "a.h94999.org/", "h95000.org/"]
    df = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)], "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    best = {}
    for h, p, v in rules:
        h = h.replace("Z", "z")
        for i, u in enumerate(urls):
            host, path = u.split("/", 1)
            if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p):
                best[i] = max(best.get(i, (0, 0, "", "")), (len(h + p), len(h), h + p, v))
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(df, table).collect()}
    assert got == {i: best[i][2:] if i in best else (None, "allow") for i in range(len(urls))} and len(best) == 9


# Word hashing


def test_words_are_those_of_split():
    rng = random.Random(0)
    texts = ["".join(rng.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "B", "é", "\x1c", "\x85"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(300)]
    hashes, starts = hashed_words(texts, lower=True)
    assert np.diff(starts).tolist() == [len(t.split()) for t in texts]
    flat = [w.lower() for t in texts for w in t.split()]
    names = {}
    for w, h in zip(flat, hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    s = Spans(hashes)
    assert s.of(np.array([0]), np.array([0])) == s.of(np.array([5]), np.array([5]))
