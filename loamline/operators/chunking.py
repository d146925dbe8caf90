"""Chunks of included files: bounded spans with exact byte and line ranges that together cover the file.

Files are independent; each is cut in the task that reads it (``mapInArrow``), as merging and splitting by a token budget are folds that start
anew at each cut. Sources are bounded by ``classify.MAX_BYTES``. The counter of tokens is a parameter whose name belongs to the
configuration; the one here counts words and single marks.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache
from itertools import accumulate, pairwise
from operator import xor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loamline.functions.identity import base64, chunk_id, content_hash, file_id
from loamline.functions.text import LANGUAGES

#: Fixed values of the chunk budget.
TARGET, MOST, OVERLAP = 800, 1500, 0.1
#: Levels of classes in classes; what lies deeper stays one unit, split by the budget.
DEEPEST = 64
COUNTER = "words-and-marks-v1"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_SPACE = r"[\s﻿]"
_SETTING = re.compile(rf"{_SPACE}*(\[|[\w.-]+{_SPACE}*[:=])")
_FENCE = re.compile(rf"{_SPACE}*(```|~~~)")
_HEADING = re.compile(rf"#{{1,6}}{_SPACE}")
_BRACES = ("java", "typescript", "tsx", "javascript")
_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}]", re.S)
_CONTAINER = re.compile(r"\b(?:class|interface)\s+[A-Za-z_$]")
_COMMENTS = re.compile(r"\A(?:\s*(?://[^\n]*|/\*.*?\*/|@\w+(?:\([^)\n]*\))?))*\s*", re.S)
BLANK = " \t\n\r\x0b\x0c\ufeff"
_GAP = re.compile(f"[{BLANK}]*")
# A called name is looked for once in each run of its characters, which may be very long.
_NAMED = re.compile(r"\b(?:function|class|interface|enum|type|const|let|var)\s+([A-Za-z_$][\w$]*)|(?<![\w$])(?:(?![A-Za-z_$])\w)*+([A-Za-z_$][\w$]*+)\s*+\(")


@dataclass
class Unit:
    start: int
    end: int
    kind: str
    scope: str | None = None
    symbol: str | None = None
    signature: str | None = None


@dataclass(frozen=True)
class Counter:
    """How tokens are counted. ``spans`` gives where tokens begin and end, if any part of a text has as many as it touches; without it, texts are counted anew and prefixes are tried."""

    name: str
    count: Callable[[str], int]
    spans: Callable[[str], tuple[list[int], list[int]]] | None = None


@cache
def _classes() -> np.ndarray:
    """Of each code point: 1 in words, 0 white space, 2 a mark."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    found = np.full(len(every), 2, np.int8)
    for pattern, value in ((r"\w+", 1), (r"\s+", 0)):
        for m in re.finditer(pattern, every):
            found[m.start() : m.end()] = value
    return found


def _token_spans(text: str) -> tuple[list[int], list[int]]:
    """Begins and ends of ``_TOKEN``."""
    own = np.zeros(len(text) + 2, np.int8)
    own[1:-1] = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word, mark = own == 1, own[1:-1] == 2
    begins, ends = mark | (word[1:-1] & ~word[:-2]), mark | (word[1:-1] & ~word[2:])
    return np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist()


def words_and_marks() -> Counter:
    return Counter(COUNTER, lambda text: sum(1 for _ in _TOKEN.finditer(text)), _token_spans)


class Counted:
    """Tokens of parts of a text, each after a prefix that ends a line. With ``spans``, the text is gone through once."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        self.begins, self.ends = counter.spans(text) if counter.spans else ([], [])
        self.own: dict[str, int] = {}

    def prefix(self, prefix: str) -> int:
        if prefix not in self.own:
            self.own[prefix] = self.counter.count(prefix)
        return self.own[prefix]

    def of(self, prefix: str, start: int, end: int) -> int:
        if not self.counter.spans:
            return self.counter.count(prefix + self.text[start:end])
        return self.prefix(prefix) + (bisect.bisect_left(self.begins, end) - bisect.bisect_right(self.ends, start) if start < end else 0)


def vocabulary(path: str) -> Counter:
    """Tokens of a tokenizer file (``.json``, or ``.model`` of sentencepiece), special strings taken as text; named by the file's content."""
    with open(path, "rb") as f:
        name = f"vocabulary-{hashlib.sha256(f.read()).hexdigest()[:16]}"
    if path.endswith(".model"):
        import sentencepiece

        pieces_of = sentencepiece.SentencePieceProcessor(model_file=path)
        return Counter(name, lambda text: len(pieces_of.encode(text)))
    import tokenizers

    known = tokenizers.Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()
    known.encode_special_tokens = True
    return Counter(name, lambda text: len(known.encode(text, add_special_tokens=False).ids))


def prefix_of(path: str, unit: Unit) -> str:
    """As ``functions.text.enrichment``."""
    return "\n".join(x for x in (path[:240], (unit.scope or "")[:160], (unit.symbol or "")[:160]) if x) + "\n"


def line_units(text: str, markdown: bool) -> list[Unit]:
    """As ``operators.units``: a heading or blank line outside a fence starts a unit in Markdown, a section or setting line elsewhere."""
    rows = list(_LINE.finditer(text))
    if markdown:
        inside = accumulate((bool(_FENCE.match(m.group())) for m in rows), xor, initial=False)
        starts = [m.start() for m, held in zip(rows, inside) if not held and (_HEADING.match(m.group()) or not m.group().strip(BLANK))]
    else:
        starts = [m.start() for m in rows if _SETTING.match(m.group())]
    return [Unit(a, b, "documentation" if markdown else "configuration") for a, b in pairwise(sorted({0, len(text), *starts}))]


def _lexed(text: str) -> tuple[dict[int, int], list[tuple[int, int]]] | None:
    """Closing brace of each opening one, in order, and comments and strings of several lines; None if braces do not close."""
    close, opened, long = {}, [], []
    for m in _LEX.finditer(text):
        if m.group() == "{":
            opened.append(m.start())
            close[m.start()] = 0
        elif m.group() == "}":
            if not opened:
                return None
            close[opened.pop()] = m.end()
        elif "\n" in m.group():
            long.append(m.span())
    return None if opened else (close, long)


class Braces:
    """Statements of languages with braces, by lines; classes and interfaces, and what is over the limit, are entered, down to ``DEEPEST`` levels."""

    def __init__(self, text: str, path: str, counted: Counted, close: dict[int, int], long: list[tuple[int, int]]):
        self.text, self.path, self.counted, self.close = text, path, counted, close
        self.opens, self.long, self.depth = list(close), long, []

    def blocks(self, a: int, b: int) -> list[tuple[int, int]]:
        """Outermost blocks of a range."""
        out, i = [], bisect.bisect_left(self.opens, a)
        while i < len(self.opens) and self.opens[i] < b:
            out.append((self.opens[i], self.close[self.opens[i]]))
            i = bisect.bisect_left(self.opens, out[-1][1])
        return out

    def statements(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Ranges without white space around them that end where a line does, outside blocks and long tokens."""
        i, j = (bisect.bisect_left(self.long, (x,)) for x in (a, b))
        held, start = iter(sorted(self.blocks(a, b) + self.long[i:j])), a
        span = next(held, None)
        for m in _LINE.finditer(self.text, a, b):
            while span and span[1] <= m.end():
                span = next(held, None)
            goes_on = span and span[0] < m.end() or self.text.startswith("{", _GAP.match(self.text, m.end()).end())
            if goes_on and m.end() < b:
                continue
            body = self.text[start : m.end()]
            left, right = len(body) - len(body.lstrip(BLANK)), len(body.rstrip(BLANK))
            if right > left:
                yield start + left, start + right
                start = m.end()

    def visit(self, a: int, b: int, scope: str | None = None) -> Iterator[Unit]:
        for s, e in self.statements(a, b):
            unit = self.unit(s, e, scope)
            block = next(iter(self.blocks(s, e)), None)
            enter = block and len(self.depth) < DEEPEST and (_CONTAINER.search(_COMMENTS.sub("", self.text[s : block[0]])) or self.counted.of(prefix_of(self.path, unit), s, e) > MOST)
            if not enter:
                yield unit
                continue
            inner = ".".join(x for x in (scope, unit.symbol) if x) or None
            yield Unit(s, block[0] + 1, "declaration", inner)
            self.depth.append(inner)
            yield from self.visit(block[0] + 1, block[1] - 1, inner)
            self.depth.pop()

    def unit(self, s: int, e: int, scope: str | None) -> Unit:
        body = self.text[s:e]
        if re.match(r"(import|package)\b", body):
            return Unit(s, e, "imports", scope)
        if re.match(r"//|/\*", body) and not self.blocks(s, e):
            return Unit(s, e, "documentation", scope)
        head = re.split(r"[\n{]", _COMMENTS.sub("", body), maxsplit=1)[0]
        named = _NAMED.search(head)
        symbol = (named.group(1) or named.group(2))[:200] if named else None
        called = "{" in body and re.search(r"\bfunction\b|\)\s*(:[^{]*|throws\b[^{]*)?$|=>\s*$", head.rstrip()) and not _CONTAINER.search(head)
        return Unit(s, e, "function" if called else "declaration", scope, symbol, head[:240] if called else None)


def brace_units(text: str, path: str, count: Callable[[str], int], counted: Counted | None = None) -> list[Unit] | None:
    """Units that cover the text; between two, white space goes to the first and anything else to the second. None if braces do not close."""
    lexed = _lexed(text)
    if lexed is None:
        return None
    counted = counted or Counted(text, Counter("", count))
    found = list(Braces(text, path, counted, *lexed).visit(0, len(text)))
    if not found:
        return [Unit(0, len(text), "declaration")]
    edges = [0, *[_GAP.match(text, u.end).end() for u in found[:-1]], len(text)]
    return [replace(u, start=a, end=b) for u, (a, b) in zip(found, pairwise(edges), strict=True)]


def merged(path: str, units: list[Unit], counted: Counted) -> list[Unit]:
    """Neighbours of one kind and scope, functions apart, as long as they fit the target; what is merged has no symbol."""
    out: list[Unit] = []
    for u in units:
        last = out[-1] if out else None
        if last and (last.kind, last.scope) == (u.kind, u.scope) and u.kind != "function" and counted.of(prefix_of(path, last), last.start, u.end) <= TARGET:
            out[-1] = Unit(last.start, u.end, u.kind, u.scope)
        else:
            out.append(replace(u))
    return out


def pieces(text: str, path: str, unit: Unit, overlap: float, counted: Counted) -> Iterator[Unit]:
    """The unit if it fits the limit; otherwise prefixes that fit the target, cut after a newline where one is in their second half."""
    fit = _by_spans if counted.counter.spans else _by_trial
    end_of = fit(prefix_of(path, unit), unit, counted)
    start = unit.start
    while start < unit.end:
        end = end_of(start)
        if end < unit.end:
            newline = text.rfind("\n", start, end)
            if newline >= start + (end - start) / 2:
                end = newline + 1
        yield replace(unit, start=start, end=end)
        if end == unit.end:
            return
        start = max(start + 1, end - int((end - start) * overlap))


def _by_spans(prefix: str, unit: Unit, counted: Counted) -> Callable[[int], int]:
    begins, last, own = counted.begins, bisect.bisect_left(counted.begins, unit.end), counted.prefix(prefix)

    def end_of(start: int) -> int:
        first = bisect.bisect_right(counted.ends, start)
        return unit.end if own + last - first <= MOST else begins[first + max(1, TARGET - own)]

    return end_of


def _by_trial(prefix: str, unit: Unit, counted: Counted) -> Callable[[int], int]:
    """Looks no further than a range that is over the limit, which is doubled until it is."""

    def end_of(start: int) -> int:
        tokens = lambda end: counted.of(prefix, start, end)
        size = 4096
        while tokens(min(start + size, unit.end)) <= MOST:
            if start + size >= unit.end:
                return unit.end
            size *= 2
        ends = range(start + 1, min(start + size, unit.end))
        return max(start + 1, start + bisect.bisect_right(ends, TARGET, key=tokens))

    return end_of


def spans(text: str, path: str, mode: str = "syntax", counter: Counter | None = None, counted: Counted | None = None) -> tuple[str, list[Unit]]:
    """How the file was read, and its chunks in order. ``counted``: the text, where the caller goes on to count its chunks."""
    counted = counted or Counted(text, counter or words_and_marks())
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "text")
    if not text:
        return "empty", []
    whole = [Unit(0, len(text), "fallback")]
    if mode == "window":
        status, units = "window-baseline", whole
    elif language in _BRACES:
        found = brace_units(text, path, counted.counter.count, counted)
        status, units = ("brace-boundaries", found) if found else ("parse-error-fallback", whole)
    elif language == "markdown":
        status, units = "markdown-boundaries", line_units(text, True)
    elif language in ("json", "yaml", "toml", "ini"):
        status, units = "config-text-fallback", line_units(text, False)
    else:
        status, units = "unsupported-language-fallback", whole
    overlap = OVERLAP if mode == "window" or "fallback" in status else 0.0
    return status, [p for u in merged(path, units, counted) for p in pieces(text, path, u, overlap, counted)]


_SCHEMA = "path string, content_hash string, language string, parse_status string, ordinal bigint, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, chunk_kind string, scope string, symbol string, signature string, search_text string, token_count bigint"


@cache
def _counter(path: str | None) -> Counter:
    """Once for each Python worker."""
    return vocabulary(path) if path else words_and_marks()


#: Bytes of files, and of their chunks, that a worker holds as Python objects at a time; a larger file is one of its own.
_HELD = 4_000_000


def _slices(b: pa.RecordBatch, text: str, most: int = _HELD) -> Iterator[pa.RecordBatch]:
    """Neighbours of at most so many bytes of text, and as many rows as they may have at 1,000 bytes each."""
    ends, a = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))]), 0
    while a < b.num_rows:
        end = max(a + 1, min(int(np.searchsorted(ends, ends[a] + most, "right")) - 1, a + most // 1000))
        yield b.slice(a, end - a)
        a = end


def _chunked(mode: str, tokenizer: str | None):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) if i not in (10, 11, 12) else pa.array(c, pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in (part for whole in batches for part in _slices(whole, "content")):
            rows, held = [], 0
            for path, content, digest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                counted = Counted(content, counter)
                status, found = spans(content, path, mode, counted=counted)
                language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "text")
                byte, line, at = 0, 1, 0
                for k, u in enumerate(found):
                    # Starts only move on, so byte and line offsets are carried along.
                    step = content[at : u.start]
                    byte, line, at = byte + len(step.encode()), line + step.count("\n"), u.start
                    body = content[u.start : u.end]
                    size, inner = len(body.encode()), body[:-1].count("\n")
                    prefix = prefix_of(path, u)
                    kind = u.kind if body.strip(BLANK) else "structural"
                    rows.append((path, digest, language, status, k, byte, byte + size, line, line + inner, kind, u.scope, u.symbol, u.signature, prefix + body, counted.of(prefix, u.start, u.end)))
                    held += size + 1000
                    if held > _HELD:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def chunks(files: DataFrame, config_hash: str, mode: str = "syntax", tokenizer: str | None = None) -> DataFrame:
    """Chunk records of included ``files`` (path, content): content-derived ids, ranges, kind, scope, symbol, search text, token count.

    ``tokenizer`` is a file that all executors can read; without one, words and single marks are counted.

    Empty files have no chunks; rows without a path or content are left out.
    """
    # Dealt by path: what a task cuts must not hang on how many files or row groups the table came in.
    dealt = files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content").repartition("path")
    own = dealt.select("path", "content", content_hash(F.col("content")).alias("content_hash"))
    cut = own.mapInArrow(_chunked(mode, tokenizer), _SCHEMA)
    named = cut.withColumn("file_id", file_id(base64(F.col("path")), F.col("content_hash"))).withColumn("config_hash", F.lit(config_hash))
    return named.withColumn("id", chunk_id(F.col("file_id"), F.col("config_hash"), F.col("start_byte"), F.col("end_byte"), F.col("ordinal")))


def counted(rows: DataFrame, tokenizer: str | None = None, text: str = "search_text") -> DataFrame:
    """``rows`` plus n_tokens of a text, by the counter of ``chunks``; of a null, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in (part for whole in batches for part in _slices(whole, text)):
            n = [counter.count(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n_tokens"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("n_tokens", LongType())]))

