"""Token counts without token ids.

A text is cut into pre-tokens that no piece of the vocabulary crosses. Within a batch of texts the pieces of each distinct
pre-token are counted once; these counts join the pre-token frequencies of each text and are summed.

The join is done inside the tasks, batch by batch: (document, pre-token) pairs outnumber what a shuffle within 1.5 times
the input can hold. Memory is bounded by the batch and by a cache of ``CACHE`` pre-tokens for each Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, texts_of

SPACE = "▁"
#: Distinct pre-tokens whose counts a worker keeps between batches; beyond it the cache starts anew.
CACHE = 200_000
#: Words of a batch are counted together up to about this many bytes of text.
BLOCK_BYTES = 8 << 20
_RUNS = re.compile(rb" *[^ ]+| +")


class PieceCounter:
    """Counts of SentencePiece pieces. Needs a model that keeps all white space, adds a leading space, and has no piece
    with a space after another character, so that spaces part pre-tokens."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or self.model.encode(" a  b ", out_type=str)[0] not in (SPACE, SPACE * 2) or "".join(self.model.encode(" a  b ", out_type=str)) != f"{SPACE * 2}a{SPACE * 2}b{SPACE}":
            raise ValueError("spaces do not part this model's pre-tokens")
        self.alone = 1  # of a single space after the last word
        self.known: dict[bytes, int] = {}

    def counts(self, pretokens: list[bytes]) -> list[int]:
        """Of pre-tokens without their leading space."""
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        if new := [p for p in pretokens if p not in known]:
            for p, ids in zip(new, self.model.encode([p.decode("utf-8", "replace") for p in new], num_threads=1), strict=True):
                known[p] = len(ids) if p else self.alone
        return [known[p] for p in pretokens]

    def batch(self, texts: list[bytes]) -> np.ndarray:
        starts, found = np.zeros(len(texts) + 1, np.int64), []
        for k, t in enumerate(texts):
            t = t.replace(SPACE.encode(), b" ")
            if not t:
                pass
            elif b"  " in t or t[:1] == b" " or t[-1:] == b" ":
                found += [x[1:] for x in _RUNS.findall(b" " + t)]
            else:
                found += t.split(b" ")
            starts[k + 1] = len(found)
        if not found:
            return np.zeros(len(texts), np.int64)
        coded = pa.array(found, pa.large_binary()).dictionary_encode()
        each = np.array(self.counts(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[starts[1:]] - sums[starts[:-1]]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``) for each row; null texts are empty and have no tokens.

    ``model`` is a path that every executor can read, or a name that ``public_tokenizers.path`` knows there.
    Repeated rows stay; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        if os.path.exists(model):
            at = model
        else:
            import public_tokenizers

            at = public_tokenizers.path(model)
        counter = PieceCounter(at)
        for b in batches:
            texts = texts_of(b.column(1))
            for part in blocks(texts, BLOCK_BYTES):
                own = texts[part]
                n = counter.batch(own)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part.start : part.stop], pa.array([len(t) for t in own], pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"]
                )

    kept = docs.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
