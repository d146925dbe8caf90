"""Prefix trie, toxicity and spelling variants against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import lm_scoring, prefix_trie, queries, spelling, toxicity
from test_operators import CLASH, ODD, frame

# Prefix trie


def brute_trie(rows):
    """Rows of (conv_id, turn, role, text) to the set of node tuples."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    said = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0
        saved[p] = own + sum(saved[x] for x in children[p])
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def talks(seed, n, texts="abc", longest=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, longest)):
            rows.append((c - 10, t, rng.choice(["u", "v"]), rng.choice(texts) + " x" * rng.randint(0, 2)))
    return rows


ODD_TALKS = [
    *talks(1, 60), (None, 0, "u", "lost"), (200, None, "u", "null turn"), (200, 0, None, None), (200, 0, None, None), (201, 1, "u", "tie a"), (201, 1, "u", "tie b"), (201, 1, "u", "tie a"),
    *[(300, k, "u", f"turn {k % 7}") for k in range(2500)], *[(301, k, "u", f"turn {k % 7}") for k in range(2400)], *[(c, k, "u", f"copy {k}") for c in range(400, 460) for k in range(5)], (500, 0, "u", "w " * 20000),
]


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("d", "m", "p1", "k", "n", "id", "part", "w")}).repartition(3)


@pytest.mark.parametrize("shard_rows", [100_000, 40, 1])
def test_trie_matches_brute_force(spark, shard_rows):
    """However the tries are cut into shards, and with conversations of more turns than one block."""
    got = prefix_trie.prefix_trie(table_of(spark, ODD_TALKS), shard_rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_trie(ODD_TALKS), key=key)


def test_trie_of_one_first_turn(spark):
    """A third of all conversations begin with one turn, and 3,000 are copies."""
    rows = [(c, 0, "u", "hello there") for c in range(1, 1500)] + [(c, 1, "u", f"then {c}") for c in range(1, 1500)] + [(c, 0, "u", "copy") for c in range(5000, 8000)]
    got = prefix_trie.prefix_trie(table_of(spark, rows), 200)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_edges(spark):
    assert prefix_trie.prefix_trie(table_of(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(table_of(spark, [(None, 1, "u", "x")])).count() == 0
    # The conversation that its turns come from is not there, so its own first turns go and nothing is left.
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert [tuple(r) for r in prefix_trie.prefix_trie(table_of(spark, [(alone, 0, "u", "x")])).collect()] == brute_trie([(alone, 0, "u", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_double_array():
    rng = random.Random(3)
    for width in (3, 60, 5000):
        paths = list({tuple(rng.randrange(width) for _ in range(rng.randint(1, 6))) for _ in range(800)})
        levels = [(np.array([i for i, p in enumerate(paths) if len(p) > d]), np.array([p[d] for p in paths if len(p) > d])) for d in range(6)]
        trie = prefix_trie.DoubleArray(len(paths), levels)
        slot_of = {}
        for d, (own, slots) in enumerate(zip((x for x, _ in levels), trie.walk(len(paths), levels))):
            for i, s in zip(own.tolist(), slots.tolist()):
                assert s > 0 and slot_of.setdefault(paths[i][: d + 1], s) == s
        assert len(set(slot_of.values())) == len(slot_of) and all(trie.check[s] == (slot_of[p[:-1]] if len(p) > 1 else 0) for p, s in slot_of.items())
        strange = [(np.array([0]), np.array([width + 5])), (np.array([0]), np.array([0]))]
        assert [x.tolist() for x in trie.walk(1, strange)] == [[-1], [-1]]


# Toxicity


def test_toxicity_ranks_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, data).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((g > b) + 0.5 * (g == b) for g in toxic for b in clean) / (len(toxic) * len(clean)) > 0.93
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.01 and sum(s >= 0.5 for s in toxic) / len(toxic) > 0.8


def labelled(spark, n=600):
    """Texts in which one group is named mostly where insults are; the others seldom."""
    rng, rows = random.Random(5), []
    fill = lambda k: " ".join(f"w{rng.randrange(300)}" for _ in range(k))
    for i in range(n):
        toxic = i % 3 == 0
        group = rng.choice(["muslims"] * 8 + ["people", "christians"]) if toxic else rng.choice(["people"] * 8 + ["christians", "jews"])
        rows.append((i, f"{fill(12)} {group} {fill(5)}. {fill(8)} {rng.choice(['idiot', 'scum', 'moron']) if toxic and rng.random() < 0.8 else fill(1)} {fill(4)}.", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_neutral_mentions_of_groups(spark):
    """What a sentence scores must not follow from the group that it names: swaps move scores little, and less than without the penalty."""
    docs, labels = labelled(spark)
    plain, paired = (toxicity.train(docs, labels, pairing=p) for p in (0.0, 20.0))
    say = lambda m, g, more="": float(m.scores([f"w1 w2 {g} w3 w4{more}".encode()])[0])
    assert say(plain, "muslims") > 0.5 > say(paired, "muslims")
    for g in ("muslims", "jews", "hindus", "christians"):
        assert abs(say(paired, g) - say(paired, "people")) < 0.05 < say(paired, g, " idiot") - say(paired, g)
        assert say(paired, g, " idiot") > 0.5
    assert toxicity.swaps(b"Muslims pray. The people of it.", {b"muslims": [b"people"]}) == [(b"muslims", b"people")]


def test_toxicity_matches_a_loop(spark):
    """Features and scores recomputed word by word."""
    docs, labels = labelled(spark, 150)
    m = toxicity.train(docs, labels)
    at = dict(zip(m.hashes.tolist(), m.weights.tolist()))
    texts = [t.text for t in docs.limit(20).collect()] + ["", "Muslims! IDIOT-scum é", "a b c"]
    for t in texts:
        found = set()
        for w in __import__("re").findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()):
            found |= {int(x) for x in toxicity.of_words([w])[0]}
        want = 1 / (1 + math.exp(-m.base - sum(at.get(h, 0.0) for h in found)))
        assert math.isclose(float(m.scores([t.encode()])[0]), want, rel_tol=1e-9)


def test_toxicity_edges(spark):
    odd, empty = frame(spark, ODD, *CLASH), frame(spark, [], *CLASH)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (99, 1), (5, 1)], "doc_id bigint, toxic int")
    m = toxicity.train(odd, labels)
    rated = toxicity.scored(odd, m)
    assert rated.columns == [*[c for c in odd.columns if c != "score"], "score"] and rated.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.scored(empty, m).count() == 0 and toxicity.train(empty, labels).scores([b"", b"x"]).tolist() == pytest.approx([0.5, 0.5])
    assert toxicity.train(odd, labels.where("toxic = 1")).scores([b"x"])[0] > 0.5 and toxicity.train(odd, labels.limit(0)).scores([b"x"])[0] == pytest.approx(0.5)


# Automaton of a block


def test_block_automaton_carries_states():
    """Lanes that start inside a text have the states of the walk through the whole automaton, token by token, and so the scores."""
    rng = random.Random(8)
    texts = [" ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(n)).encode() for n in (0, 1, 2, 3, 255, 256, 257, 258, 600, 5000)]
    tokens, starts = lm_scoring.token_hashes(texts)
    words, at = np.unique(tokens, return_inverse=True)
    sizes = np.diff(starts)
    pairs, triples = Counter(), Counter()
    for a, n in zip(starts, sizes):
        x = [len(words), *at[a : a + n].tolist()]
        pairs.update(zip(x, x[1:]))
        triples.update(zip(x[:-2], x[1:-1], x[2:]))
    kept2, kept3 = ({k: n for k, n in c.items() if n >= lm_scoring.LEAST} for c in (pairs, triples))
    counts = np.bincount(at, minlength=len(words))
    whole = lm_scoring.Automaton(words, counts, len(tokens), len(words), len(texts), kept2, kept3)
    packed = {"words_": lm_scoring.pack_sorted(words), "at_": lm_scoring.pack(at.astype(np.uint32)), "sizes_": lm_scoring.pack(sizes.astype(np.uint64)), "learn_": b"\1" * len(texts), "rate_": b"\1" * len(texts)}
    g = lm_scoring._Grams(packed, lm_scoring.PAIR, lm_scoring.TRIPLE)
    number = lambda k: (int(g.before[k]), int(at[k]))
    of_pair, of_triple = [number(k) for k in g.pair_first], [(int(g.before[k - 1]), *number(k)) for k in g.triple_first]
    doubled = lambda c, keys: np.array([2 * (c[k] if c[k] >= lm_scoring.LEAST else 0) + 1 for k in keys], np.uint64)
    order = np.argsort(np.append(words, lm_scoring.START))
    sums = lambda n, items: [np.array(x, np.uint64) for x in zip(*[[sum(v[i] for k, v in items if k == c) for i in range(3)] for c in n])] or [np.zeros(0, np.uint64)] * 3
    of_words = sums(order.tolist(), [(k[0], (1, n, int(counts[k[1]]) + 1)) for k, n in kept2.items()])
    of_pairs = sums([p for p in of_pair if p in kept2], [(k[:2], (1, n, kept2[k[1:]])) for k, n in kept3.items()])
    own = lm_scoring.BlockAutomaton(g, [[(2 * counts + 1).astype(np.uint64)], [doubled(pairs, of_pair)], [doubled(triples, of_triple)], of_words, of_pairs], whole.base)
    gains, states = own.walk(g.at, g.starts, g.sizes)
    name_of = {v: k for k, v in whole.state_of.items()}
    mine = {len(words) + 1 + i: p for i, p in enumerate(p for p in of_pair if p in kept2)}
    for a, n in zip(starts, sizes):
        state, total = whole.start, 0.0
        for k in range(a, a + n):
            before, w = state, int(at[k])
            while state != whole.root and state * whole.width + w not in whole.arcs:
                total += whole.backoff[state]
                state = whole.failure[state]
            weight, state = (whole.own[w], w) if state == whole.root else whole.arcs[state * whole.width + w]
            total += weight
            assert mine.get(int(states[k]), int(states[k])) == name_of.get(state, state), (k - a, before)
        assert math.isclose(gains[a : a + n].sum(), total, rel_tol=1e-9, abs_tol=1e-12)
    assert len(set(states.tolist()) - set(range(len(words)))) > 100


# Spelling variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least=3):
    counts = Counter()
    for k, t in rows:
        low = (t or "").translate({i: i + 32 for i in range(65, 91)})
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-m, x) for x, m in words.items() if one_apart(w, x))
        if near and -near[0][0] >= 2 * n:
            form[w] = near[0][1]
        out[w] = [n, len(near), -near[0][0] if w in form else None]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, *out[w])
    return sorted(out.values(), key=repr)


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeiountrsé") for _ in range(rng.randint(4, 11))) for _ in range(60)]
    rows = []
    for k in range(n):
        said = []
        for _ in range(60):
            w = base[min(rng.randrange(60), rng.randrange(60))]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aen") + w[i:], w[:i] + rng.choice("aenÿ") + w[i + 1 :]])
            said.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, " ".join(said)))
    return rows


@pytest.mark.parametrize("shard_words", [50_000, 30, 3])
def test_variants_match_all_pairs(spark, shard_words):
    """However the vocabulary is cut into shards, and where one key has more words than a shard."""
    rows = [*misspelt(1, 120), *ODD, (7001, "z" * 30000 + " " + ("y" * 20000 + " ") * 4 + ("y" * 20001 + " ") * 9)]
    got = [tuple(r) for r in spelling.variants(frame(spark, rows, *CLASH, "word", "form"), shard_words=shard_words).collect()]
    want = brute_variants(rows)
    assert sorted(got, key=repr) == want and any(r[2] != r[1] and r[1] for r in want) and any(r[4] > 5 for r in want)


def test_both_halves_find_each_word_once():
    rng = random.Random(1)
    for trial in range(30):
        letters = rng.choice(["ab", "abc", "abcdefgÿé"])
        held = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.choice([1, 2, 40, 200]))})
        asked = [q for q in {*held, *("".join(rng.choice(letters + "z") for _ in range(rng.randint(2, 8))) for _ in range(100))} if len(q) > 1]
        if asked:
            index = spelling.Bidirectional(held)
            each = [(q, last, c) for q in asked for last in (False, True) for c in (-1, 0, 1)]
            q, t = index.near([x[0] for x in each], np.array([x[1] for x in each]), np.array([x[2] for x in each]))
            assert sorted((each[a][0], each[a][2], index.words[b]) for a, b in zip(q, t)) == sorted((x, len(w) - len(x), w) for x in asked for w in held if one_apart(x, w))


def test_spelling_edges(spark):
    assert spelling.variants(frame(spark, [], *CLASH)).count() == 0 and spelling.variants(frame(spark, [(1, None), (2, ""), (None, "ab cd")])).count() == 0
    chain = " ".join("aaaa" + "bcdefgh"[: k + 1] + " " for k in range(5) for _ in range(3 * 2**k))
    got = {r.word: (r.form, r.root) for r in spelling.variants(frame(spark, [(1, chain)]), slips=1 << 40).collect()}
    assert got["aaaab"] == ("aaaabc", "aaaabcdef") and got["aaaabcdef"] == (None, "aaaabcdef")
