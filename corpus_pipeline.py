"""Documents to training data: language, quality, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.

Verdicts belong to rows by key and text, null-safely: rows of a null or repeated key, of a null or an empty
text are judged like others, and a rejected row takes no other row with it. Columns beside those of
documents are dropped by the first stage, whatever their names; empty tables pass as empty tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undaflow.llm import langid, mixing, neardup, quality, tokenize
from undaflow.llm.settings import OTHER, TARGETS
from undaflow.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row(key, text_hash):
    """What names a row in verdicts: its key, or none, and the hash of its text."""
    return F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), text_hash)


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key and text ``verdict`` (doc_id, text_hash) holds."""
    d = docs.select(*COLUMNS).withColumn("_row", _row(docs["doc_id"], neardup.text_hash(docs["text"])))
    return d.join(verdict.select(_row(F.col("doc_id"), F.col("text_hash")).alias("_row")), "_row", "left_semi")


def _small_batches(spark: SparkSession) -> None:
    """Lets Python workers take 2 000 rows at a time, unless the session has a number of its own: the stages share
    their workers, and whole texts of five times as many rows would be held in several forms at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those whose letters fit no learned language. Ties, repeated rows and null
    keys: each row by its own text. A null text has no letter and goes."""
    _small_batches(spark)
    model = langid.learn(docs, ~langid.held_out(docs["doc_id"]))
    return langid.label(docs, model, keep=COLUMNS).where("lang_pred <> 'und' and fits").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or lie far from every reference go; null and empty texts fail."""
    return _kept(docs, quality.quality(docs).where("kept")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest key, under one key the smallest hash of the text, and of
    rows equal in key and text the smallest row. Texts without words are no copies of each other and stay."""
    _small_batches(spark)
    found = neardup.near_duplicates(docs).where("kept")
    alone = found.where("component is null").select("doc_id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("s.*")
    kept = _kept(docs, alone.union(first))
    return kept.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("s")).select("s.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of n copies gives n equal rows, at their places in the global order. A null source belongs to
    the other sources; rows of one key get one count."""
    return mixing.mix(docs.select(*COLUMNS), TARGETS, OTHER).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every row; a null text has no tokens."""
    _small_batches(spark)
    return tokenize.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False, held=100_000)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Viterbi paths, similarity joins and merges are beyond SQL: ``tests/llm`` holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
