"""A committed Git tree as a data source: subtrees are partitions, listed and read where the tasks run.

The repository's folder must be readable on the executors. Replaced objects are not followed.
"""

from __future__ import annotations

import os
import subprocess
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ENV = {"GIT_NO_REPLACE_OBJECTS": "1", "GIT_TERMINAL_PROMPT": "0"}


def _git(folder: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", folder, *args], env=os.environ | _ENV, check=True, capture_output=True).stdout


def commit_of(folder: str, ref: str) -> tuple[str, str]:
    """Commit and its time as text, of a full ref, a branch or tag name that only one has, or a commit. Revision expressions are refused."""
    if not ref or ref.startswith("-") or any(c in ref for c in "~^:@{}*?[\\ "):
        raise ValueError(f"{ref!r} is not a plain ref")
    if ref == "HEAD":
        return tuple(_git(folder, "show", "-s", "--format=%H %cI", "HEAD").decode().strip().split(" ", 1))
    known = _git(folder, "for-each-ref", "--format=%(refname)", "refs/heads", "refs/tags").decode().split("\n")
    names = [x for x in (ref, f"refs/heads/{ref}", f"refs/tags/{ref}") if x in known]
    if len(names) > 1:
        raise ValueError(f"{ref!r} is both a branch and a tag")
    if not names and not (4 <= len(ref) <= 64 and set(ref.lower()) <= set("0123456789abcdef")):
        raise LookupError(f"there is no {ref!r}")
    return tuple(_git(folder, "show", "-s", "--format=%H %cI", f"{names[0] if names else ref}^{{commit}}").decode().strip().split(" ", 1))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """ref, commit of every tag, annotated ones followed to their commits."""
    rows = []
    for line in _git(folder, "for-each-ref", "--format=%(refname) %(objectname) %(*objectname)", "refs/tags").decode().splitlines():
        ref, own, target = (line.split(" ") + [""])[:3]
        rows.append((ref, target or own))
    return spark.createDataFrame(rows, "ref string, commit string")


ENTRY = "path string, path_bytes binary, mode string, type string, oid string, bytes bigint"


def _listed(folder: str, *args: str) -> Iterator[tuple[str, str, str, str, bytes]]:
    """mode, type, oid, size, path of each entry, as they come."""
    with subprocess.Popen(["git", "-C", folder, "ls-tree", "--full-tree", "-z", "-l", *args], env=os.environ | _ENV, stdout=subprocess.PIPE) as p:
        left = b""
        while got := p.stdout.read(1 << 16):
            *whole, left = (left + got).split(b"\0")
            for entry in whole:
                head, _, path = entry.partition(b"\t")
                yield *head.decode().split(), path
    if p.returncode:
        raise LookupError(f"git cannot list {args} of {folder}")


class Subtree(InputPartition):
    """One folder's tree by its object, or, of a folder that is split further, the entries beside its folders."""

    def __init__(self, oid: str, prefix: bytes, whole: bool):
        super().__init__((oid, prefix, whole))
        self.oid, self.prefix, self.whole = oid, prefix, whole


class _TreeReader(DataSourceReader):
    def __init__(self, folder: str, commit: str, under: str, content: bool, subtrees: int):
        self.folder, self.commit, self.under, self.content, self.subtrees = folder, commit, under, content, subtrees

    def partitions(self) -> list[Subtree]:
        """Folders by breadth, split into theirs until there are ``subtrees``; the driver lists only the folders that it splits."""
        root = f"{self.commit}^{{tree}}" if not self.under else f"{self.commit}:{self.under}"
        oid = _git(self.folder, "rev-parse", "--verify", "--end-of-options", root).decode().strip()
        if _git(self.folder, "cat-file", "-t", oid) != b"tree\n":
            raise LookupError(f"{self.under!r} is not a folder")
        waiting, split = deque([(oid, self.under.encode() + b"/" if self.under else b"")]), []
        while waiting and len(waiting) + len(split) < self.subtrees:
            at, prefix = waiting.popleft()
            split.append(Subtree(at, prefix, False))
            waiting.extend((own, prefix + name + b"/") for _, kind, own, _, name in _listed(self.folder, at) if kind == "tree")
        return split + [Subtree(at, prefix, True) for at, prefix in waiting]

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        entries = (e for e in _listed(self.folder, *(["-r"] if part.whole else []), part.oid) if e[1] != "tree")
        blobs = _Blobs(self.folder) if self.content else None
        try:
            rows, held = [], 0
            for mode, kind, oid, size, name in entries:
                path, n = part.prefix + name, int(size) if size != "-" else 0
                try:
                    text = path.decode()
                except UnicodeDecodeError:
                    text = None
                rows.append((text, path, mode, kind, oid, n, *([blobs.read(oid) if kind == "blob" else None] if blobs else [])))
                held += n if blobs else 0
                if len(rows) == 2000 or held > _BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            if blobs:
                blobs.close()

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if self.content else [])]
        names = [c.split(" ")[0] for c in ENTRY.split(", ")] + (["content"] if self.content else [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


#: Contents in one batch, about; one blob may be more.
_BATCH_BYTES = 32 << 20


class _Blobs:
    """Contents by one ``git`` that stays open."""

    def __init__(self, folder: str):
        self.git = subprocess.Popen(["git", "-C", folder, "cat-file", "--batch"], env=os.environ | _ENV, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, oid: str) -> bytes:
        self.git.stdin.write(oid.encode() + b"\n")
        self.git.stdin.flush()
        head = self.git.stdout.readline().split()
        if len(head) != 3 or head[0] != oid.encode() or head[1] != b"blob":
            raise LookupError(f"git has no blob {oid}: {head}")
        content = self.git.stdout.read(int(head[2]))
        self.git.stdout.read(1)
        return content

    def close(self) -> None:
        self.git.stdin.close()
        self.git.wait()


class GitTree(DataSource):
    """Options: folder, commit; under (a folder of the tree; only it is listed), content (false leaves contents unread), subtrees."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return ENTRY + (", content binary" if self._content() else "")

    def _content(self) -> bool:
        return self.options.get("content", "true") == "true"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _TreeReader(o["folder"], o["commit"], o.get("under", "").strip("/"), self._content(), int(o.get("subtrees", 64)))


def tree(spark: SparkSession, folder: str, commit: str, under: str = "", content: bool = True, subtrees: int = 64) -> DataFrame:
    """path (null if its bytes are not UTF-8), path_bytes, mode, type, oid, bytes, content (binary; null for submodules).

    A partition for each subtree lists and reads it in its task; an empty tree has no rows, and ``under`` must name a folder.
    """
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").options(folder=folder, commit=commit, under=under, content=str(content).lower(), subtrees=subtrees).load()
