"""python -m loamline COMMAND: a corpus of Git commits from the command line; results are JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.plans.build import build, preset
from loamline.plans.corpus import Catalog, Corpus
from loamline.sources import git


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamline")
    p.add_argument("--root", required=True, help="folder of the corpus, in any store that Spark writes")
    p.add_argument("--name", default="corpus")
    p.add_argument("--repo", help="a registered repository: the folder is then that of a catalogue")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("import", help="build a commit and publish it")
    c.add_argument("--path", required=True, help="folder of the Git repository")
    c.add_argument("--ref", default="HEAD")
    c.add_argument("--mode", choices=("syntax", "window"), default="syntax")
    c.add_argument("--previous", help="a published version to build on")
    c.add_argument("--tokenizer", help="file of a vocabulary to count tokens by; all executors can read it")
    c.add_argument("--dry-run", action="store_true", help="counts and changes only")
    sub.add_parser("versions")
    c = sub.add_parser("resolve")
    c.add_argument("selector")
    c = sub.add_parser("search")
    c.add_argument("selector")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--path")
    c.add_argument("--language")
    c = sub.add_parser("read")
    c.add_argument("selector", nargs="?")
    c.add_argument("path", nargs="?")
    c.add_argument("--handle", help="of a search result, in place of a version and a path")
    c.add_argument("--lines", metavar="A:B")
    c.add_argument("--context", type=int, default=0)
    c = sub.add_parser("sync-tags", help="point names to the commits of a repository's tags")
    c.add_argument("--path", required=True)
    c = sub.add_parser("verify", help="violations of a published version")
    c.add_argument("selector")
    c.add_argument("--tokenizer")
    c = sub.add_parser("repo-add", help="register a repository in a catalogue")
    c.add_argument("remote")
    c.add_argument("--title", required=True)
    c.add_argument("--description", default="")
    c.add_argument("--tag", action="append", default=[], metavar="KEY=VALUE")
    sub.add_parser("repo-list", help="collections of a catalogue, ready or partial")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    catalog = Catalog(spark, args.root)
    if args.command == "repo-add":
        if bad := [t for t in args.tag if "=" not in t]:
            raise ValueError(f"{bad[0]!r} is not KEY=VALUE")
        made = catalog.register(args.title, args.remote, args.description, dict(t.split("=", 1) for t in args.tag))
        return catalog.repositories().where(F.col("collection") == made)
    if args.command == "repo-list":
        return catalog.discover()
    corpus = catalog.select(args.repo) if args.repo else Corpus(spark, args.root, args.name)
    if args.command == "verify":
        return corpus.verify(args.selector, args.tokenizer)
    if args.command == "import":
        commit, when = git.commit_of(args.path, args.ref)
        earlier, config = None, preset(args.mode, tokenizer=args.tokenizer)
        if args.previous:
            earlier = corpus.build_of(args.previous, config)
        own = build(git.tree(spark, args.path, commit), config, earlier, args.tokenizer)
        if args.dry_run:
            counts = own.counts().withColumn("commit", F.lit(commit))
            if not earlier:
                return counts
            changes = own.changes.groupBy().pivot("change", ["added", "modified", "deleted", "unchanged"]).count()
            return counts.crossJoin(changes)  # one row each
        tag = corpus.publish(own, commit, when)
        return corpus.versions().where(F.col("tag") == tag)
    if args.command == "versions":
        return corpus.versions()
    if args.command == "resolve":
        return corpus.versions().where(F.col("tag") == corpus.resolve(args.selector).tag)
    if args.command == "search":
        return corpus.search(args.selector, args.query, args.limit, args.path, args.language)
    if args.command == "read":
        if bool(args.handle) == bool(args.selector and args.path) or args.handle and (args.selector or args.lines):
            raise ValueError("read takes a version and a path, or a handle alone")
        if args.handle:
            return corpus.open(args.handle, args.context)
        a, b = (int(x) for x in args.lines.split(":")) if args.lines else (None, None)
        return corpus.read(args.selector, args.path, a, b, args.context)
    corpus.release(git.tags(spark, args.path).withColumn("at", F.current_timestamp()))
    return corpus.releases()


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loamline").getOrCreate()
    try:
        for line in run(spark, args).toJSON().toLocalIterator():
            print(line)
    except (LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
