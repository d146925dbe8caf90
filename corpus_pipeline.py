"""From raw documents to a training mix: five filters and edits, each a function of (spark, docs, sf_dir) to a DataFrame.

Every stage works on all that the one before it kept; its result is written and read again. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars); the last adds how much of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import quality
from loamline.llm.common import doc_split, table, written
from loamline.llm.decontaminate import without_leaks
from loamline.llm.jaccard_join import representatives
from loamline.llm.mixing import mix
from loamline.llm.queries import domain_of, weights
from loamline.llm.substring_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more)."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"), use=doc_split("doc_id", 5) != 0)
    return quality.scored(docs, model, score="quality_").where("quality_ >= 0.3").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies: five-word shingles, Jaccard 0.8 or more, links followed."""
    return representatives(docs.select(*COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words in windows of 20 words that start earlier in the corpus; texts that lose none stay as they are, and
    documents that lose all their words go."""
    kept = without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = kept.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its five-word shingles)."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with whole epochs and tokens of the last epoch that it takes of each."""
    return mix(docs.select(*COLUMNS), weights(spark), domain=domain_of("source"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_to_weights),
]

#: Gradient-boosted trees and seeded hashes are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
