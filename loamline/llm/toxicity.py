"""Toxicity: a linear classifier over words and their beginnings, whose scores may not depend on which group a sentence names.

1. Every labelled text (up to ``max_rows``) is a set of features: its words (runs of letters and digits, A-Z lower-cased) and their first 3 to 8 bytes,
   as 64-bit hashes. Spark counts how many toxic and other texts hold each feature; the ``features`` that tell them apart best are kept, and
   those of the identity terms with them.
2. Each labelled sentence that names an identity term is copied with the term swapped for each other term of its group, the group's neutral word
   among them. What differs between the sentence and its copy is a pair.
3. Weights minimise the logistic loss, an absolute and a square penalty, and ``pairing`` times the mean square of the difference of the scores (log odds)
   of each pair, so that a group's name by itself moves a score no more than a neutral word does.

The model (sorted hashes and weights, some tens of kB whatever the corpus) goes with the tasks. Every word of every whole text is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _BYTE_CODES, HASH_BYTES, Spans, blocks, text_blocks, written

#: Terms that name groups of people, by group; the first of each is neutral. A parameter of ``train``.
IDENTITY_TERMS = (
    ("people", "men", "women", "boys", "girls"),
    ("person", "man", "woman", "boy", "girl"),
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("people", "gays", "lesbians", "bisexuals", "heterosexuals"),
    ("adult", "gay", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("people", "blacks", "whites", "asians", "africans", "latinos"),
    ("local", "black", "white", "asian", "african", "latino", "american", "european", "mexican", "chinese"),
    ("people", "immigrants", "refugees", "foreigners"),
    ("adult", "disabled", "blind", "deaf", "elderly", "young"),
    ("menschen", "männer", "frauen", "christen", "muslime", "juden", "flüchtlinge"),
    ("gens", "hommes", "femmes", "chrétiens", "musulmans", "juifs", "réfugiés"),
    ("personas", "hombres", "mujeres", "cristianos", "musulmanes", "judíos", "refugiados"),
)
PREFIXES = (3, 4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SENTENCE = re.compile(rb"[^.!?\n]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all texts with their texts' places, repeats included, a part of the texts after the other."""
    for part in blocks(texts, HASH_BYTES):
        own = texts[part]
        codes = np.frombuffer(b"\n".join(own).lower(), np.uint8)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = _LETTER[codes]
        a, b = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        of = part.start + np.searchsorted(np.cumsum([len(t) + 1 for t in own]), a, side="right")
        spans = Spans(_BYTE_CODES[codes])
        yield spans.of(a, b), of
        for n in PREFIXES:
            long = b - a > n
            yield spans.of(a[long], a[long] + n), of[long]


def of_words(words: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each word."""
    found: list[list[np.ndarray]] = [[] for _ in words]
    for hashes, of in features(words):
        for h, k in zip(hashes, of):
            found[k].append(h)
    return [np.unique(np.array(f, np.uint64)) for f in found]


def swaps(text: bytes, groups: dict[bytes, list[bytes]]) -> list[tuple[bytes, bytes]]:
    """(term, other term) for each identity term of each sentence and each other term of its groups."""
    found = []
    for sentence in _SENTENCE.findall(text.lower()):
        words = set(_WORD.findall(sentence))
        found += [(term, other) for term in sorted(words & groups.keys()) for other in groups[term] if other not in words]
    return found


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    base: float

    def __post_init__(self):
        #: Hashes whose leading 20 bits no feature has need no search.
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) places, sorted, of the features that the model has."""
        n, found = max(1, len(self.hashes)), [np.zeros(0, np.int64)]
        for hashes, of in features(texts):
            near = np.flatnonzero(self.some[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[near]), n - 1)
            own = self.hashes[at] == hashes[near] if len(self.hashes) else np.zeros(0, bool)
            found.append(np.unique(of[near][own] * n + at[own]))
        return np.divmod(np.unique(np.concatenate(found)), n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        of, at = self.places(texts)
        return 1 / (1 + np.exp(-self.base - np.bincount(of, self.weights[at], len(texts))))


def fit(of: np.ndarray, at: np.ndarray, y: np.ndarray, n_features: int, pairs: list[tuple[np.ndarray, np.ndarray]], pairing: float = 5.0, sparse: float = 5e-5, smooth: float = 1e-5, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights and base by accelerated proximal steps. ``of`` and ``at`` are the rows and features of the ones in the design, ``pairs`` the features that only a
    sentence has and those that only its copy has. Without rows of both labels the base is their share."""
    n = max(1, len(y))
    share = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)
    base, w = float(np.log(share / (1 - share))), np.zeros(n_features + 1)
    if len(y) == 0 or y.min() == y.max():
        return w[:-1], base
    w[-1] = base
    pair_of = np.concatenate([np.zeros(0, np.int64), *[np.full(len(a) + len(b), k) for k, (a, b) in enumerate(pairs)]])
    pair_at = np.concatenate([np.zeros(0, np.int64), *[x for p in pairs for x in p]])
    sign = np.concatenate([np.zeros(0), *[np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs]])
    n_pairs = max(1, len(pairs))

    def gradient(v: np.ndarray) -> np.ndarray:
        z = v[-1] + np.bincount(of, v[at], len(y))
        r = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(at, r[of], n_features) / n + smooth * v[:-1], r.mean())
        change = np.bincount(pair_of, v[pair_at] * sign, n_pairs)
        g[:-1] += 2 * pairing / n_pairs * np.bincount(pair_at, change[pair_of] * sign, n_features)
        return g

    def curved(v: np.ndarray) -> np.ndarray:
        """The largest curvature that the loss can have along ``v``."""
        x = v[-1] + np.bincount(of, v[at], len(y))
        g = np.append(np.bincount(at, x[of], n_features) / (4 * n) + smooth * v[:-1], x.mean() / 4)
        change = np.bincount(pair_of, v[pair_at] * sign, n_pairs)
        g[:-1] += 2 * pairing / n_pairs * np.bincount(pair_at, change[pair_of] * sign, n_features)
        return g

    v = np.ones(n_features + 1) / np.sqrt(n_features + 1)
    for _ in range(30):
        v = curved(v)
        top = np.linalg.norm(v)
        v /= top
    step, ahead, t = 1 / (1.1 * top), w.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * gradient(ahead)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparse, 0)
        if (ahead - new) @ (new - w) > 0:  # the momentum has turned against the descent
            t = 1.0
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / grown * (new - w), new, grown
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000, n_features: int = 4096, pairing: float = 5.0, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """A model fitted on at most ``max_rows`` rows of ``labels`` for which ``use`` holds, those with the smallest hashes of ``key``.

    Null keys and labels are left out; labels above 0 count as 1. Null texts are empty. Repeated rows of either table count each time, up to ``max_rows``
    in all. Without rows of both labels every score is their share (0.5 without rows).
    """
    own = labels.where(use if use is not None else F.lit(True)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    own = own.select(F.col(key).alias("label_key"), (F.col(label) > 0).cast("int").alias("label"))
    own = own.orderBy(F.xxhash64(F.lit(1), "label_key"), "label").limit(max_rows)  # so it is small enough to broadcast
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(own), F.col("k") == F.col("label_key"))
    rows = written(joined.select("t", "label", F.xxhash64("k", "t").alias("o")).orderBy("o", "label").limit(max_rows).repartition("o"), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy()
            for part, texts in text_blocks(b.column(0)):
                # Words and beginnings of one length have no hash in common, so each part tells distinct (feature, text) pairs by itself.
                found = [np.zeros((2, 0), np.uint64)]
                for h, of in features(texts):
                    order = np.lexsort([of, h])
                    h, of = h[order], of[order].astype(np.uint64)
                    first = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
                    found.append(np.stack([h[first], of[first]]))
                hashes, of = np.concatenate(found, axis=1)
                hashes, inverse = np.unique(hashes, return_inverse=True)
                bad = np.bincount(inverse, y[part][of.astype(np.int64)], len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(hashes)) - bad)], names=["h", "bad", "good"])

    sums = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = float(sums.bad), float(sums.n - sums.bad)
    # How far the share of toxic texts that hold it is from that of the others, squared, over its variance.
    share = (F.col("bad") + F.col("good")) / (bad + good + 1e-9)
    far = F.col("bad") / (bad + 1e-9) - F.col("good") / (good + 1e-9)
    tells = far * far / (share * (1 - share) + 1e-9)
    best = rows.mapInArrow(counted, "h bigint, bad bigint, good bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = best.where("bad + good >= 3").orderBy(F.desc(tells), "h").limit(n_features).select("h").toArrow()["h"].to_numpy().view(np.uint64)
    groups: dict[bytes, list[bytes]] = {}
    for g in terms:
        for term in g:
            groups.setdefault(term.encode().lower(), []).extend(x.encode().lower() for x in g if x != term)
    named = sorted(groups)
    of_term = dict(zip(named, of_words(named)))
    model = Model(np.unique(np.concatenate([best, *of_term.values()])), np.zeros(0), 0.0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b.column(0)):
                of, at = model.places(texts)
                lists = pa.array(np.split(at, np.searchsorted(of, np.arange(1, len(texts)))), pa.list_(pa.int64()))
                swapped = pa.array([[x.decode() for p in sorted(set(swaps(t, groups))) for x in p] for t in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([lists, swapped, *[b.column(i)[part.start : part.stop] for i in (1, 2)]], names=["x", "swaps", "y", "o"])

    found = rows.mapInArrow(placed, "x array<bigint>, swaps array<string>, y int, o bigint").orderBy("o", "y").toArrow()
    x, y = found["x"].to_pylist(), found["y"].to_numpy().astype(np.float64)
    of = np.repeat(np.arange(len(x)), [len(r) for r in x])
    at = np.concatenate([np.zeros(0, np.int64), *[np.array(r, np.int64) for r in x]])
    pairs = []
    for r in found["swaps"].to_pylist():
        for a, b in zip(r[::2], r[1::2]):
            p, q = of_term[a.encode()], of_term[b.encode()]
            pairs.append(tuple(np.searchsorted(model.hashes, np.setdiff1d(*z)) for z in ((p, q), (q, p))))
    weights, base = fit(of, at, y, len(model.hashes), pairs, pairing)
    kept = weights != 0
    return Model(model.hashes[kept], weights[kept], base)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs``, all columns, with ``score``, the chance of being toxic.

    Null texts score as empty ones, and rows of equal texts alike. A column that already has the name of ``score`` is replaced. Repeated rows stay; an
    empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [model.scores(texts) for _, texts in text_blocks(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *values]))], names=[*b.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
