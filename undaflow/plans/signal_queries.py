"""Queries on signals and label sequences: ``events`` by event_type, ordered by (ts, event_id), and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pointwise as P
from ..operators import sequence as S
from ..operators import windows as W
from ..operators.blocks import indexed

SRC, ORD = ["event_type"], ["ts", "event_id"]
_W = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_C = "(SELECT event_type, ts, event_id, user_id, value - 250 AS x FROM events)"
_N = f"(SELECT *, x / max(abs(x)) OVER (PARTITION BY event_type) AS y FROM {_C})"
_MU = "CAST(trunc((sign(y) * ln(1 + 255 * abs(y)) / ln(256.0::DOUBLE) + 1) / 2 * 255 + 0.5) AS BIGINT)"


def signal(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "user_id", (F.col("value") - 250).alias("x"))


def samples(spark, sf_dir: str) -> DataFrame:
    """The signal with the place ``t`` of each sample in its source."""
    return indexed(signal(spark, sf_dir), SRC, ORD)


def _r(c):
    return F.round(c, 6)


def _symbols(spark, d):
    return S.normalize(samples(spark, d), SRC, "x").withColumn("q", P.mu_law_compress(F.col("y")))


def mulaw_runs(spark, d):
    runs = S.runs(_symbols(spark, d), SRC, "t", "q")
    return runs.groupBy("event_type", F.col("label").alias("q")).agg(F.count("*").alias("n_runs"), F.sum(F.col("stop") - F.col("start")).alias("n_samples"))


def mulaw_compress(spark, d):
    return _symbols(spark, d).select("event_id", "q")


def mulaw_expand(spark, d):
    return _symbols(spark, d).select("event_id", _r(P.mu_law_expand(F.col("q"))).alias("x"))


def normalize_inf(spark, d):
    return S.normalize(signal(spark, d), SRC, "x").select("event_id", _r("y").alias("y"))


def normalize_l2(spark, d):
    return S.normalize(signal(spark, d), SRC, "x", p=2.0).select("event_id", _r("y").alias("y"))


def linearize(spark, d):
    return _symbols(spark, d).select("event_id", _r(P.linearize(F.col("q"), 256)).alias("y"))


def activations(spark, d):
    x = F.col("x") / 100
    return signal(spark, d).select("event_id", _r(F.tanh(x)).alias("tanh"), _r(P.sigmoid(x)).alias("sigmoid"), _r(P.softplus(x)).alias("softplus"),
                                   _r(P.mish(x)).alias("mish"), P.relu(x).alias("relu"), _r(P.gate(x, -x)).alias("gate"), _r(P.safe_log(x)).alias("safe_log"))


def emphasis(spark, d):
    return S.emphasis(samples(spark, d), SRC, "t", "x", 0.9).select("event_id", _r("y").alias("y"))


def diff_over_time(spark, d):
    return S.difference(samples(spark, d), SRC, "t", "x").select("event_id", _r("y").alias("y"))


def zero_crossings(spark, d):
    return S.zero_crossings(samples(spark, d), SRC, "t", "x").select("event_id", "up", "down")


def local_max(spark, d):
    return S.local_max(samples(spark, d), SRC, "t", "x").select("event_id", "peak")


def segments(spark, d):
    return S.runs(indexed(signal(spark, d), ["user_id"], ORD), ["user_id"], "t", "event_type")


def cuts_to_labels(spark, d):
    return S.cut_labels(samples(spark, d), SRC, "t", F.col("x") > 200).select("event_id", "label")


def frames_tumbling(spark, d):
    return S.tumbling(samples(spark, d), SRC, "t", "x", 8).select("event_type", "frame", F.posexplode("v").alias("i", "x")).select("event_type", "frame", "i", _r("x").alias("x"))


def repeat_rate(spark, d):
    f = S.tumbling(_symbols(spark, d), SRC, "t", "q", 16)
    return W.repeat_rate(f, "v", 16).select("event_type", "frame", _r("rate").alias("rate"))


def label_histogram(spark, d):
    return S.histogram(signal(spark, d), SRC, "x", 20, -250.0, 250.0)


def merge_labels(spark, d):
    return S.dense_codes(signal(spark, d), "user_id").groupBy("code").agg(F.count("*").alias("n"))


def argmax_labels(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", P.arg_max(F.col("embedding")).alias("label"))


def band_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return S.band_pairs(e, "vec_id", "v", 6).select("i", "j", _r("cosine").alias("cosine"))


QUERIES = {f.__name__: f for f in (mulaw_runs, mulaw_compress, mulaw_expand, normalize_inf, normalize_l2, linearize, activations, emphasis, diff_over_time, zero_crossings,
                                   local_max, segments, cuts_to_labels, frames_tumbling, repeat_rate, label_histogram, merge_labels, argmax_labels, band_cosine)}
_Q = f"(SELECT *, {_MU} AS q FROM {_N})"
ORACLE = {
    "mulaw_runs": f"""WITH a AS (SELECT *, CASE WHEN q IS DISTINCT FROM lag(q) {_W} THEN 1 ELSE 0 END AS n FROM {_Q}),
b AS (SELECT *, sum(n) {_W} AS s FROM a), c AS (SELECT event_type, s, min(q) AS q, count(*) AS k FROM b GROUP BY ALL)
SELECT event_type, q, count(*) AS n_runs, CAST(sum(k) AS BIGINT) AS n_samples FROM c GROUP BY ALL""",
    "mulaw_compress": f"SELECT event_id, q FROM {_Q}",
    "mulaw_expand": f"SELECT event_id, round(sign(z) * (exp(abs(z) * ln(256.0::DOUBLE)) - 1) / 255, 6) AS x FROM (SELECT event_id, q / 255.0::DOUBLE * 2 - 1 AS z FROM {_Q})",
    "normalize_inf": f"SELECT event_id, round(y, 6) AS y FROM {_N}",
    "normalize_l2": f"SELECT event_id, round(x / sqrt(sum(x * x) OVER (PARTITION BY event_type)), 6) AS y FROM {_C}",
    "linearize": f"SELECT event_id, round((q / 256.0::DOUBLE - 0.5) * 2, 6) AS y FROM {_Q}",
    "activations": f"""SELECT event_id, round(tanh(z), 6) AS tanh, round(1 / (1 + exp(-z)), 6) AS sigmoid, round(ln(1 + exp(z)), 6) AS softplus, round(z * tanh(ln(1 + exp(z))), 6) AS mish,
greatest(z, 0.0::DOUBLE) AS relu, round(tanh(z) / (1 + exp(z)), 6) AS gate, round(ln(greatest(z, 1e-5::DOUBLE)), 6) AS safe_log FROM (SELECT event_id, x / 100 AS z FROM {_C})""",
    "emphasis": f"SELECT event_id, round(x - 0.9::DOUBLE * lag(x, 1, 0.0::DOUBLE) {_W}, 6) AS y FROM {_C}",
    "diff_over_time": f"SELECT event_id, round(x - lag(x) {_W}, 6) AS y FROM {_C}",
    "zero_crossings": f"SELECT event_id, coalesce(lag(x) {_W} < 0 AND x > 0, false) AS up, coalesce(lag(x) {_W} > 0 AND x < 0, false) AS down FROM {_C}",
    "local_max": f"SELECT event_id, coalesce(x > lag(x) {_W} AND x >= lead(x, 1, x) {_W}, false) AS peak FROM {_C}",
    "segments": """WITH a AS (SELECT *, row_number() OVER w - 1 AS t, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS seg_id FROM a)
SELECT user_id, seg_id, min(event_type) AS label, min(t) AS start, max(t) + 1 AS stop FROM b GROUP BY ALL""",
    "cuts_to_labels": f"SELECT event_id, CAST(sum(CASE WHEN x > 200 THEN 1 ELSE 0 END) {_W} AS BIGINT) AS label FROM {_C}",
    "frames_tumbling": f"""WITH a AS (SELECT event_type, x, row_number() {_W} - 1 AS t FROM {_C})
SELECT event_type, t // 8 AS frame, CAST(t % 8 AS INTEGER) AS i, round(x, 6) AS x FROM a WHERE t // 8 * 8 + 8 <= (SELECT count(*) FROM events e WHERE e.event_type = a.event_type)""",
    "repeat_rate": f"""WITH a AS (SELECT event_type, q, row_number() {_W} - 1 AS t FROM {_Q})
SELECT event_type, t // 16 AS frame, round(1 - (count(DISTINCT q) - 1) / 15.0::DOUBLE, 6) AS rate FROM a GROUP BY ALL HAVING count(*) = 16""",
    "label_histogram": f"SELECT event_type, CAST(least(floor((x + 250) / 500 * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM {_C} WHERE x BETWEEN -250 AND 250 GROUP BY ALL",
    "merge_labels": "SELECT code, count(*) AS n FROM (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS code FROM events) GROUP BY code",
    "argmax_labels": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label FROM embeddings",
    "band_cosine": """WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.i, b.i AS j, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a JOIN e b ON a.i < b.i AND b.i - a.i <= 6""",
}
