"""From raw documents to packed sequences: each stage works on all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotscope.llm.jaccard import jaccard_join
from lotscope.llm.mixing import emitted, mix
from lotscope.llm.packing import pack
from lotscope.llm.quality import score_quality, train_quality
from lotscope.llm.queries import table, tokenizer_file
from lotscope.operators.store import written
from lotscope.llm.substring import substring_dedup

#: Documents whose quality score is below this go.
QUALITY_AT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is trained on labelled rows of the corpus's own documents table."""
    model = train_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select(F.struct("*").alias("doc"), "text"), model, "score")
    return scored.where(F.col("score") >= QUALITY_AT).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by the n-gram Jaccard join the one with the smallest doc_id; of rows that share it, one. Documents without words, or without an id, stay."""
    got = jaccard_join(docs)
    keep = written(got.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    mine = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"))
    tied = mine.join(keep, F.col("_id") == F.col("_kept"), "left_semi")
    first = tied.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("doc.text")))).where("_nth = 1")
    return first.select("doc.*").union(mine.where("_id is null").select("doc.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that lose every word go, those that lose none stay as they are."""
    got = substring_dedup(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars"))}
    return got.where("n_removed = 0 or n_removed < n_words").select(*(made[c].alias(c) if c in made else F.col(f"doc.`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix emits, repeated as often as it takes them. Null and empty texts have no words and go; a null source is a source; an empty table stays empty."""
    return emitted(docs, mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids. A null or empty text gives its end id; repeated rows are documents of their own; an empty table gives no sequences."""
    return pack(docs, tokenizer_file())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", one_of_each), ("substring dedup", without_repeats), ("mixing sources to target weights", mixed), ("packing", packed)]

#: SQL can't express the classifier, the tokenizer or the cuts: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
