"""Tables of documents, pages, conversations and events as trees of files and logs of changes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of file names by doc_id modulo 12; the last three are excluded by name.
ENDINGS = ("ts", "md", "json", "yaml", "java", "txt", "mdx", "ini", "js", "png", "min.js", "css.map")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set a session of one machine (tests) gets a new one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what several branches of a plan read."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def there(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def document_path(key: Column, source: Column) -> Column:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (key % len(ENDINGS) + 1).cast("int"))
    folder = F.when(key % 50 == 7, F.lit("vendor")).when(key % 50 == 19, F.lit("build")).otherwise(F.lit("src"))
    return F.concat_ws("/", source, folder, F.concat(key, F.lit("."), ending))


def tree(spark: SparkSession, sf_dir: str, version: str | None = None) -> DataFrame:
    """doc_id, path, mode, oid, bytes, content (text) of ``documents`` as a tree: all of them, or one of two versions to compare.

    Version A lacks keys that end in 0, B those that end in 1; B adds a line to those that end in 2. Modes make some entries symlinks and
    submodules.
    """
    key = F.col("doc_id")
    missing, edited = {None: (None, None), "A": (0, None), "B": (1, 2)}[version]
    text = F.coalesce("text", F.lit(""))
    if edited is not None:
        text = F.when(key % 10 == edited, F.concat(text, F.lit("\nrevised\n"))).otherwise(text)
    mode = F.when(key % 97 == 5, F.lit("120000")).when(key % 97 == 6, F.lit("160000")).otherwise(F.lit("100644"))
    docs = table(spark, sf_dir, "documents").where(F.lit(True) if missing is None else key % 10 != missing).select("doc_id", document_path(key, F.col("source")).alias("path"), mode.alias("mode"), text.alias("content"))
    return docs.select("doc_id", "path", "mode", F.sha2("content", 256).alias("oid"), F.octet_length("content").cast("bigint").alias("bytes"), "content")


def raw_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path, mode, oid, bytes, content (binary) of all files under a folder that Spark can read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read.select("path", F.lit("100644").alias("mode"), F.sha2("content", 256).alias("oid"), F.col("length").alias("bytes"), "content")
