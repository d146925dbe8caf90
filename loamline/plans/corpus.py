"""A published corpus: immutable versions under one folder, names that point to them, search and reads pinned to a version.

What a version adds is written to a folder of its own, phase by phase, and checked there before an entry in the log makes it visible; that entry is the
commit, so a job that fails on the way leaves nothing that readers see, and the next one for the same commit goes on behind its last whole phase. Names (releases) are rows;
the latest by time wins. The folder can be in any store that Spark writes.
"""

from __future__ import annotations

import json
import uuid
from base64 import b64decode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loamline.functions.identity import base64, content_hash, release_alias, version_tag
from loamline.functions.text import excerpt, first_token, normalized_remote, slug
from loamline.operators import catalog, checks, chunking, search, versions
from loamline.operators.reading import read_lines

from . import segments as segments_
from .build import BUILDER, Build, config_hash, inventory, inventory_digest, preset
from .build import build as make
from .log import Attempt, Log, State

PUBLISHED = "commit string, commit_time string, tag string, build_id string, snapshot string, config_hash string, n_records bigint, hash_sum string, hash_xor bigint, number int"
#: What a manifest says beside the digest of its records.
#: Columns of chunks that an index keeps with its postings, for exact filters.
FILTERS = ("path", "language")
MANIFEST = ("repository", "commit", "builder", "config_hash", "build_id", "n_entries", "inventory_sum", "inventory_xor")
RELEASES = "ref string, commit string, at timestamp"
ALIASES = "alias string, target string, at timestamp"



class _Folder:
    """Tables under one folder, which are empty until something has been written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


class Corpus(_Folder):
    """Versions of one repository. ``log`` says what there is (see ``plans.log``); a version is a list of segments (see ``plans.segments``)."""

    TABLES = ("inventory", "files", "chunks", "records")

    def __init__(self, spark: SparkSession, root: str, name: str):
        super().__init__(spark, root)
        self.name, self.log = name, Log(spark, self.root)

    def _published(self) -> DataFrame:
        rows = [(v["commit"], v["commit_time"], v["tag"], v["build_id"], f"{self.root}/data/{v['segments'][-1]}", v["config_hash"], v["n_records"], v["hash_sum"], v["hash_xor"], n) for n, v in self.log.state().versions.items()]
        return self.spark.createDataFrame(rows, PUBLISHED)

    def versions(self) -> DataFrame:
        """Published versions, by commit time as text, then commit."""
        return self._published().orderBy("commit_time", "commit")

    def _segments(self, number: int | None, state: State) -> list[dict[str, str]]:
        """The tables of each segment of a version, in order."""
        if number is None:
            return []
        of = {v["segments"][-1]: v["phases"] for v in state.versions.values()}
        return [of[s] for s in state.versions[number]["segments"]]

    def _live(self, segments: list[dict[str, str]], table: str) -> DataFrame:
        return segments_.live(self.spark, f"{self.root}/data", segments, table)

    def table(self, selector: str, name: str) -> DataFrame:
        """One of ``TABLES`` of a version."""
        return self._table_of(self.resolve(selector).number, name)

    def _table_of(self, number: int, name: str) -> DataFrame:
        return self._live(self._segments(number, self.log.state()), name).drop(*segments_.KEYS)

    def build_of(self, selector: str, config: dict) -> Build:
        """A version as something to build on."""
        number = self.resolve(selector).number
        return Build(config, *[self._table_of(number, x) for x in ("inventory", "files", "chunks")])

    def publish(self, build: Build, commit: str, commit_time: str, branch: str = "main") -> str:
        """The tag of the version; publishing a commit again with equal records changes nothing, with others it fails.

        What the head of the branch has is not written again. Names that wait for the commit are pointed to it. After a failure, publishing the same commit again goes on
        behind the phases that were whole; while two writers publish to one branch, the one that began last wins and the other is told so (``Fenced``).
        """
        tag = self._known(build, commit)
        if tag is None:
            tag = self._publish(self._begin(branch, commit, build.config_hash, build.inventory), build, commit, commit_time)
        self._point()
        return tag

    def publish_tree(self, tree: DataFrame, commit: str, commit_time: str, config: dict | None = None, tokenizer: str | None = None, branch: str = "main") -> str:
        """``build`` of a tree on the head of the branch, and ``publish``; the cut is a phase too, so that it is not done twice after a failure."""
        config = config or preset(tokenizer=tokenizer)
        state, own = self.log.state(), config_hash(config)
        head = state.heads.get(branch)
        previous = None
        if head is not None and state.versions[head]["config_hash"] == own:
            held = self._segments(head, state)
            previous = Build(config, *[self._live(held, x).drop(*segments_.KEYS) for x in ("inventory", "files", "chunks")])
        if any(v["commit"] == commit and v["config_hash"] == own for v in state.versions.values()):
            return self.publish(make(tree, config, previous, tokenizer), commit, commit_time, branch)
        attempt = self._begin(branch, commit, own, inventory(tree, config["maxFileBytes"]))
        tag = self._publish(attempt, make(tree, config, previous, tokenizer, keep=lambda df, name: attempt.table(name, df)), commit, commit_time)
        self._point()
        return tag

    def fork(self, selector: str, branch: str) -> None:
        """A new branch whose head is a published version: an entry in the log, no data. A branch that is there is left as it is (ValueError)."""
        v = self.resolve(selector)

        def entry(state: State) -> dict:
            if branch in state.heads or branch in state.open:
                raise ValueError(f"there is a branch {branch}")
            return {"kind": "branch", "branch": branch, "version": v.number}

        self.log.add(entry)

    def branches(self) -> DataFrame:
        """branch, commit, tag of heads."""
        state = self.log.state()
        return self.spark.createDataFrame([(b, state.versions[n]["commit"], state.versions[n]["tag"]) for b, n in sorted(state.heads.items())], "branch string, commit string, tag string")

    def _known(self, build: Build, commit: str) -> str | None:
        for v in self.log.state().versions.values():
            if v["commit"] == commit and v["config_hash"] == build.config_hash:
                listed = build.metadata(self.name, commit).first()
                if [v[c] for c in ("n_records", "hash_sum", "hash_xor")] != list(build.digest().first()) or [v[c] for c in MANIFEST] != [listed[c] for c in MANIFEST]:
                    raise ValueError("this commit is published with other records")
                return v["tag"]
        return None

    def _begin(self, branch: str, commit: str, config: str, listed: DataFrame) -> Attempt:
        """An attempt that goes on behind the phases of the one before, if that was for the same commit, configuration, inventory and head."""
        input_ = ":".join(map(str, inventory_digest(listed).first()))
        opened: dict = {}

        def entry(state: State) -> dict:
            before, own = state.open.get(branch, {}), {"commit": commit, "config_hash": config, "input": input_, "base": state.heads.get(branch)}
            same = all(before.get(k) == v for k, v in own.items())
            opened.update({"kind": "attempt", "branch": branch, **own, "folder": uuid.uuid4().hex, "phases": before["phases"] if before and same else {}})
            return opened

        number, state = self.log.add(entry)
        return Attempt(self.log, opened, number, state)

    def _publish(self, attempt: Attempt, build: Build, commit: str, commit_time: str) -> str:
        state = self.log.state()
        base = self._segments(attempt.base["number"], state) if attempt.base and len(attempt.base["segments"]) < segments_.MOST else []
        lost = None
        for table in self.TABLES:
            # The records are hashes of what has been stored.
            df = self._stored([*base, attempt.phases], build).records() if table == "records" else getattr(build, table)
            added, left = segments_.delta(segments_.keyed(df), self._live(base, table) if base else None)
            attempt.table(table, added)
            if left is not None:
                attempt.table(f"gone-{table}", segments_.names(left))
                lost = left if table == "chunks" else lost
        segments = [*base, attempt.phases]
        own, stored = self.spark.read.parquet(attempt.at("chunks")), self._stored(segments, build)
        attempt.table("build", stored.metadata(self.name, commit).coalesce(1))
        attempt.phase("index", lambda to: search.Index.write(own, to, less=lost, attributes=FILTERS, near="path"))
        wrong = self._wrong(segments, build.config_hash, build.tokenizer).limit(20).collect()
        if wrong:
            raise ValueError(f"the build is not valid: {wrong[:3]}")
        self._probe(self._index(segments), own)
        meta, digest = self.spark.read.parquet(attempt.at("build")).first(), stored.digest().first()
        tag = self.spark.range(1).select(version_tag(F.lit(commit)).alias("tag")).first().tag
        names = attempt.base["segments"] if base else []
        attempt.publish({"commit_time": commit_time, "tag": tag, "segments": [*names, attempt.folder], **digest.asDict(), **{c: meta[c] for c in MANIFEST}})
        return tag

    def _stored(self, segments: list[dict[str, str]], build: Build) -> Build:
        return Build(build.config, *[self._live(segments, x).drop(*segments_.KEYS) for x in ("inventory", "files", "chunks")], tokenizer=build.tokenizer)

    def _index(self, segments: list[dict[str, str]]) -> search.Index:
        return search.Index(self.spark, [f"{self.root}/data/{s['index']}" for s in segments], lambda hits: segments_.without(self.spark, f"{self.root}/data", segments, "chunks", hits, ["id"]), attributes=FILTERS)

    def _wrong(self, segments: list[dict[str, str]], own_hash: str, tokenizer: str | None) -> DataFrame:
        """Violations of a version as it is stored, against the records and the metadata that were written with it."""
        read = lambda x: self._live(segments, x).drop(*segments_.KEYS)
        meta = self.spark.read.parquet(f"{self.root}/data/{segments[-1]['build']}")
        own = Build(json.loads(meta.first().config), read("inventory"), read("files"), read("chunks"))
        again = own.metadata(self.name, meta.first().commit).select(*[F.col(c).alias(f"{c}_") for c in ("n_entries", "inventory_sum", "inventory_xor")])
        both = meta.crossJoin(again)  # one row each
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("n_entries", "inventory_sum", "inventory_xor")]
        listed = both.where(~(same[0] & same[1] & same[2])).select(F.lit("inventory-digest").alias("check_name"), F.col("build_id").alias("id"), F.col("inventory_sum_").alias("detail"))
        # Every file that is kept from an earlier version is stored, and every stored one is kept.
        kept = own.inventory.where("status = 'included'").select(F.col("file_id").alias("id"))
        missing = kept.join(own.files.select("id"), "id", "left_anti").select(F.lit("kept-file-missing").alias("check_name"), "id", F.lit("").alias("detail"))
        found = checks.violations(own.files, own.chunks, own.inventory, own_hash).unionByName(missing)
        if own.config["counter"] != (chunking.vocabulary(tokenizer).name if tokenizer else chunking.COUNTER):
            raise ValueError(f"tokens were counted by {own.config['counter']}: name its file")
        found = found.unionByName(checks.recount(own.chunks, tokenizer))
        return found.unionByName(checks.records(own.records(), read("records"))).unionByName(checks.identities(meta, BUILDER)).unionByName(listed)

    def verify(self, selector: str, tokenizer: str | None = None) -> DataFrame:
        """All violations (check_name, id, detail) of a published version; ``tokenizer`` is the file that its tokens were counted by."""
        v, state = self.resolve(selector), self.log.state()
        return self._wrong(self._segments(v.number, state), v.config_hash, tokenizer)

    def _probe(self, index: search.Index, chunks: DataFrame) -> None:
        """The first token of some chunk must be found, in the file of that chunk."""
        word = first_token(F.coalesce("symbol", "search_text"))
        one = chunks.select("id", "file_id", word.alias("word")).where(F.size(search.terms(F.col("word"))) > 0).limit(1).collect()
        if one and index.ranked(one[0].word, 1, chunks.where(F.col("file_id") == one[0].file_id).select("id")).limit(1).count() == 0:
            raise ValueError(f"the index does not find {one[0].word!r}")

    def release(self, refs: DataFrame) -> None:
        """Points names (ref, commit, at) to commits, published or not. What is wanted is written first; aliases of published commits follow."""
        refs.select("ref", "commit", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{self.root}/releases")
        self._point()

    def _aliases(self) -> DataFrame:
        return self._table("aliases", ALIASES).groupBy("alias").agg(F.max_by("target", "at").alias("target"))

    def _point(self) -> None:
        behind = self.releases().where("status = 'out-of-sync'").select(release_alias(F.col("ref")).alias("alias"), F.col("tag").alias("target"), F.current_timestamp().alias("at"))
        if behind.limit(1).count():
            behind.write.mode("append").parquet(f"{self.root}/aliases")

    def releases(self) -> DataFrame:
        """ref, commit, tag, status, see ``versions.release_status``."""
        latest = self._table("releases", RELEASES).groupBy("ref").agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))
        return versions.release_status(latest.withColumn("alias", release_alias(F.col("ref"))), self._published(), self._aliases())

    def resolve(self, selector: str):
        """The version that a name, tag, commit or 7 to 64 hex digits of one stand for. A known name goes before a commit, even while pending."""
        ref = selector if selector.startswith("refs/tags/") else f"refs/tags/{selector}"
        named = self.releases().where(F.col("ref") == ref).limit(1).collect()
        published = self._published()
        if named:
            if named[0].status != "available":
                raise LookupError(f"{ref} is {named[0].status}: {'publish' if named[0].status == 'pending' else 'point names to'} {named[0].commit} first")
            return self._only(published.where(F.col("tag") == named[0].tag), selector)
        return self._only(versions.matching(published, self.spark.createDataFrame([(selector,)], "selector string")).drop("selector"), selector)

    def _only(self, found: DataFrame, selector: str):
        """A commit published under two configurations is two versions, which no name or commit tells apart."""
        rows = found.limit(2).collect()
        if len(rows) != 1:
            raise LookupError(f"{selector} is {'ambiguous' if rows else 'not published'}")
        return rows[0]

    def search(self, selector: str, text: str, limit: int = 10, path: str | None = None, language: str | None = None) -> DataFrame:
        """The best chunks of a version, with excerpt, citation and a handle for ``open``; ``path`` and ``language`` are exact filters.

        A hit whose file the version's inventory does not list, with the same content, is an error.
        """
        v = self.resolve(selector)
        segments = self._segments(v.number, self.log.state())
        chunks = self._live(segments, "chunks").drop(*segments_.KEYS)
        where = {name: value for name, value in zip(FILTERS, (path, language), strict=True) if value is not None}
        best = self._index(segments).ranked(text, limit, where=where)
        listed = self._live(segments, "inventory").where("status = 'included'").select(F.col("file_id").alias("listed_"), F.col("content_hash").alias("hash_"), F.col("path").alias("path_"))
        # The best are at most 100 rows.
        found = F.broadcast(best).join(chunks, "id").join(listed, (F.col("file_id") == F.col("listed_")) & (F.col("content_hash") == F.col("hash_")) & (F.col("path") == F.col("path_")), "left")
        found = found.withColumn("id", F.when(F.col("listed_").isNull(), F.raise_error(F.concat(F.lit("not in the inventory: "), "id"))).otherwise(F.col("id")))
        cite = F.format_string("%s@%s:%s:%d-%d", F.lit(self.name), F.lit(v.commit), "path", "start_line", "end_line")
        return found.select("id", "score", "path", "language", "chunk_kind", "scope", "symbol", "start_line", "end_line", "file_id", "content_hash", excerpt(F.col("search_text")).alias("excerpt"), cite.alias("citation"), self._handle(v).alias("handle")).orderBy(F.desc("score"), "id")

    def _handle(self, v):
        parts = [F.lit(self.name), F.lit(v.commit), F.lit(v.config_hash), F.col("content_hash"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("path")]
        return F.concat(F.lit("ev1."), base64(F.to_json(F.array(*parts))))

    def open(self, handle: str, context: int = 0) -> DataFrame:
        """The lines that a handle of ``search`` stands for. It holds only for this corpus, and only while the file has the content that was found."""
        try:
            name, commit, config, digest, first, last, path = json.loads(b64decode(handle.removeprefix("ev1."), validate=True))
        except ValueError as e:
            raise ValueError("this is not a handle") from e
        if not handle.startswith("ev1.") or name != self.name:
            raise LookupError("this handle is of another corpus")
        v = self._only(self._published().where((F.col("commit") == commit) & (F.col("config_hash") == config)), commit)
        files = self._table_of(v.number, "files").where(F.col("path") == path)
        same = (F.col("content_hash") == digest) & (content_hash(F.col("source_text")) == digest)
        held = files.select("*", same.alias("same_")).limit(1).collect()
        if not held or not held[0].same_:
            raise LookupError(f"{path} does not have the content that was found")
        cut = self._table_of(v.number, "chunks").where((F.col("file_id") == held[0].id) & (F.col("start_line") == int(first)) & (F.col("end_line") == int(last)))
        if cut.limit(1).count() == 0:
            raise LookupError(f"{path} has no chunk of lines {first} to {last}")
        return read_lines(files, F.lit(v.commit), F.lit(int(first)), F.lit(int(last)), context, text="source_text")

    def read(self, selector: str, path: str, first: int | None = None, last: int | None = None, context: int = 0) -> DataFrame:
        """Lines of a file of a version, all by default; a path that is excluded reports why."""
        v = self.resolve(selector)
        entry = self._table_of(v.number, "inventory").where(F.col("path") == path).first()
        if entry is None or entry.status != "included":
            raise LookupError(f"{path} is {'not in this version' if entry is None else 'excluded: ' + entry.reason}")
        files = self._table_of(v.number, "files").where(F.col("path") == path)
        return read_lines(files, F.lit(v.commit), F.lit(first or 1), F.lit(last or 2**31 - 1), context, text="source_text")


REPOSITORIES = "collection string, name string, repo_key string, description string, tags map<string,string>, schema_version int, at timestamp"
COLLECTIONS = "collection string, purpose string, at timestamp"
#: Of the collections that this library makes.
PURPOSE = "source-corpus"


class Catalog(_Folder):
    """Repositories under one folder, each with a corpus of its own. A collection is listed first, its descriptor follows."""

    def register(self, name: str, remote: str, description: str = "", tags: dict[str, str] | None = None) -> str:
        """The collection of a repository, by its normalized remote; registering it again changes its name, description and tags."""
        row = self.spark.range(1).select(normalized_remote(F.lit(remote)).alias("repo_key"), slug(F.lit(name)).alias("slug")).withColumn("hash", F.sha2("repo_key", 256)).first()
        if row.repo_key is None:
            raise ValueError(f"{remote!r} is not the address of a repository")
        known = self.repositories().where(F.col("repo_key") == row.repo_key).first()
        collection = known.collection if known else f"{row.slug or 'repository'}-{row.hash[:12]}"
        now = F.current_timestamp().alias("at")
        if not known:
            self.spark.range(1).select(F.lit(collection).alias("collection"), F.lit(PURPOSE).alias("purpose"), now).coalesce(1).write.mode("append").parquet(f"{self.root}/collections")
        made = self.spark.createDataFrame([(collection, name, row.repo_key, description, tags or {}, 1)], REPOSITORIES.rpartition(",")[0])
        made.select("*", now).coalesce(1).write.mode("append").parquet(f"{self.root}/repositories")
        return collection

    def _descriptors(self) -> DataFrame:
        rows = self._table("repositories", REPOSITORIES)
        return rows.groupBy("collection").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("collection", "at")]), "at").alias("r")).select("collection", "r.*")

    def discover(self) -> DataFrame:
        """collection, status (ready or partial), repo_key, name."""
        return catalog.discovered(self._table("collections", COLLECTIONS).drop("at").distinct(), self._descriptors(), PURPOSE)

    def repositories(self) -> DataFrame:
        """collection, name, repo_key, description, tags, schema_version of those that are ready."""
        return self._descriptors().join(self.discover().where("status = 'ready'").select("collection"), "collection", "left_semi")

    def select(self, selector: str) -> Corpus:
        """The corpus of the one repository that a name, key, key without host, or collection stands for."""
        row = catalog.selected(self.repositories(), self.spark.createDataFrame([(selector,)], "selector string")).first()
        if row.matches != 1:
            raise LookupError(f"{selector} is {'ambiguous' if row.matches else 'not registered'}")
        return Corpus(self.spark, f"{self.root}/corpora/{row.collection}", row.collection)
