"""The training-data queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, mixing, neardup, quality, quotes, sharding, tokenize, urls
from .settings import OTHER, TARGETS

#: A fixed list of dated entries: domain, day, action.
ENTRIES = (
    ("example.net", "2024-03-01", "block"), ("example.net", "2024-07-01", "allow"), ("example.net", "2024-10-01", "block"),
    ("example.org", "2024-05-15", "block"), ("m.ththth.example.net", "2024-02-01", "allow"), ("blog.tiontion.example.com", "2024-01-10", "block"),
    ("therin.example.net", "2024-06-01", "block"), ("com", "2024-12-01", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark, sf_dir):
    return tokenize.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False)


def op2_divergence(spark, sf_dir):
    found = quality.quality(table(spark, sf_dir, "documents")).drop("text_hash")
    return found.withColumns({c: F.round(c, 6) for c in ("char_divergence", "word_divergence")})


def op3_token_counts(spark, sf_dir):
    return tokenize.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")))
    entries = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', DATE '{b}', '{c}')" for a, b, c in ENTRIES) + " AS e(domain, day, action)")
    found = urls.judge(captures, entries)
    return found.select("capture.page_id", "host", F.col("capture.fetch_day").cast("string").alias("fetch_day"), "matched", F.col("listed_since").cast("string").alias("listed_since"), "blocked")


def op6_quotation_links(spark, sf_dir):
    out = quotes.link(table(spark, sf_dir, "conversations"), role="role")
    return out.withColumn("body_sha256", F.sha2("body", 256)).drop("body")


def op7_poisson_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), TARGETS, OTHER)
    return mixed.select("doc.doc_id", "doc.source", "doc.text", F.col("copies").cast("long").alias("n_copies"), "copy", "place")


def op8_hash_tree(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(docs["doc_id"])
    model = langid.learn(docs, ~out)
    got = langid.label(docs, model)
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "fit", "fits", "spans")


def op10_projections(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.coalesce(vectors["vec_id"] % 50 == 0, F.lit(False)))


def queries() -> dict:
    ops = (op1_bpe_codec, op2_divergence, op3_token_counts, op4_near_duplicates, op5_url_lists, op6_quotation_links, op7_poisson_mix, op8_hash_tree, op9_language, op10_projections)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    from .oracle import ORACLE

    return dict(ORACLE)
