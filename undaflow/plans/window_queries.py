"""Queries on recurrences, windows, statistics and losses over ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import pointwise as P
from ..functions import units as U
from ..operators import sequence as S
from ..operators import windows as W
from .signal_queries import _C, _N, _Q, _r, samples, signal

SRC, ORD = ["event_type"], ["ts", "event_id"]


def _samples(spark, d):
    """Signal with ``t``, normalised ``y``, symbol ``q`` and the sample ``o`` that the symbol stands for."""
    return S.normalize(samples(spark, d), SRC, "x").withColumn("q", P.mu_law_compress(F.col("y"))).withColumn("o", P.mu_law_expand(F.col("q")))


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def alaw_compress(spark, d):
    return _samples(spark, d).select("event_id", P.a_law_compress(F.col("y")).alias("q"))


def alaw_expand(spark, d):
    return _samples(spark, d).select("event_id", _r(P.a_law_expand(F.col("q"))).alias("y"), _r(P.a_law_expand(F.col("q"), centered=True)).alias("centered"))


def deemphasis(spark, d):
    return W.deemphasis(_samples(spark, d).select(*SRC, "event_id", "t", F.col("y").alias("x")), SRC, "t", "x", 0.9).select("event_id", _r("y").alias("y"))


def remove_dc(spark, d):
    return W.remove_dc(samples(spark, d), SRC, "t", "x").select("event_id", F.round("y", 5).alias("y"))


def slices_strided(spark, d):
    s = W.slices(samples(spark, d), SRC, "t", "x", length=9, hop=4, shift=2, stride=4)
    return s.select("event_type", "start", F.posexplode("v").alias("i", "x")).select("event_type", "start", "i", _r("x").alias("x"))


def moving_min(spark, d):
    return W.moving_min(samples(spark, d), SRC, "t", "x", 4, 3).select("event_id", "y")


def snap_crossings(spark, d):
    z = S.sign_changes(samples(spark, d), SRC, "t", "x")
    return W.snap(z, SRC, "t", "change").select("event_id", "snapped")


def rank_values(spark, d):
    return W.ranks(signal(spark, d), SRC, "x", "event_id").select("event_id", "rank")


def running_entropy(spark, d):
    return W.running_entropy(_samples(spark, d), SRC, "t", "q").select("event_id", _r("entropy").alias("entropy"))


def label_offsets(spark, d):
    return W.label_offsets(signal(spark, d), "event_type", "user_id").select("event_id", "label_all")


def quantiles(spark, d):
    return W.quantile(signal(spark, d), SRC, "x", {"q25": 0.25, "q90": 0.9}).select("event_type", _r("q25").alias("q25"), _r("q90").alias("q90"))


def moments(spark, d):
    return W.moments(signal(spark, d), SRC, "x").select("event_type", _r("mean").alias("mean"), F.round("var", 4).alias("var"), _r("std").alias("std"))


def frame_pooling(spark, d):
    f = W.pool(S.tumbling(samples(spark, d), SRC, "t", "x", 8), "v", 8)
    return f.select("event_type", "frame", *[_r(c).alias(c) for c in ("edge_sum", "edge_mean", "sum", "mean")])


def centroids(spark, d):
    return W.centroids(_embeddings(spark, d), "label", "v").select("label", "dim", _r("mean").alias("mean"))


def mean_l1_prop(spark, d):
    return L.mean_l1_prop(_samples(spark, d), "t", "o", "y").select(_r("loss").alias("loss"))


def diff_loss(spark, d):
    return L.diff_over_time(_samples(spark, d), SRC, "t", "o", "y").select(_r("loss").alias("loss"))


def maximize_losses(spark, d):
    return L.maximize(signal(spark, d), SRC, "x").select(_r("std_loss").alias("std_loss"), _r("magnitude_loss").alias("magnitude_loss"))


def cross_entropy(spark, d):
    return L.cross_entropy(_embeddings(spark, d), "v", "label").select(_r("loss").alias("loss"))


def angular_pairs(spark, d):
    e = _embeddings(spark, d)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return e.join(after, "vec_id").select("vec_id", _r(L.angular_distance(F.col("v"), F.col("u"), True)).alias("distance"))


def soft_max(spark, d):
    e = _embeddings(spark, d).select("vec_id", F.posexplode(P.soft_max(F.col("v"))).alias("i", "p"))
    return e.select("vec_id", "i", F.round("p", 8).alias("p"))


def glu(spark, d):
    return _embeddings(spark, d).select("vec_id", F.posexplode(P.glu(F.col("v"), 32)).alias("i", "y")).select("vec_id", "i", _r("y").alias("y"))


def odd_reflection(spark, d):
    e = _embeddings(spark, d)
    return e.select("vec_id", F.posexplode(P.odd_reflect(F.col("v"), 5)).alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def unit_conversions(spark, d):
    t = F.col("event_id")
    return signal(spark, d).select("event_id", U.samples_to_frames(t, 2048, 512, as_length=True).alias("frames"), U.frames_to_samples(t, 2048, 512, as_length=True).alias("samples"),
                                   F.round(U.samples_to_seconds(t, 16000), 8).alias("seconds"), U.seconds_to_samples(t / 4, 22050).alias("from_seconds"))


QUERIES = {f.__name__: f for f in (alaw_compress, alaw_expand, deemphasis, remove_dc, slices_strided, moving_min, snap_crossings, rank_values, running_entropy, label_offsets, quantiles, moments,
                                   frame_pooling, centroids, mean_l1_prop, diff_loss, maximize_losses, cross_entropy, angular_pairs, soft_max, glu, odd_reflection, unit_conversions)}

_I = "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t"
_T = "OVER (PARTITION BY event_type ORDER BY t)"
_X = f"(SELECT *, {_I} FROM {_C})"
_S = f"(SELECT *, sign(z) * (exp(abs(z) * ln(256.0::DOUBLE)) - 1) / 255 AS o FROM (SELECT *, {_I}, q / 255.0::DOUBLE * 2 - 1 AS z FROM {_Q}))"
_E = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_K = "(1 + ln(87.6::DOUBLE))"


def _expand(y: str) -> str:
    return f"round(sign({y}) * CASE WHEN abs({y}) < 1 / {_K} THEN abs({y}) * {_K} / 87.6::DOUBLE ELSE exp(abs({y}) * {_K} - 1) / 87.6::DOUBLE END, 6)"


def _response(b: str, c: str, digits: int = 5) -> str:
    return f"""WITH a AS (SELECT event_type, event_id, t, {b} AS b FROM {_S})
SELECT n.event_id, round(sum(k.b * pow({c}::DOUBLE, n.t - k.t)), {digits}) AS y FROM a n JOIN a k ON n.event_type = k.event_type AND k.t <= n.t GROUP BY n.event_id"""


ORACLE = {
    "alaw_compress": f"""SELECT event_id, CAST(greatest(0, least(255, ceil((sign(y) * CASE WHEN abs(y) < 1 / 87.6::DOUBLE THEN 87.6::DOUBLE * abs(y) / {_K}
ELSE (1 + ln(87.6::DOUBLE * abs(y))) / {_K} END + 1) / 2 * 255))) AS BIGINT) AS q FROM {_N}""",
    "alaw_expand": f"SELECT event_id, {_expand('u')} AS y, {_expand('(u - 1)')} AS centered FROM (SELECT event_id, 2 * q / 256.0::DOUBLE AS u FROM {_Q})",
    "deemphasis": _response("0.1::DOUBLE * y", "0.9", 6),
    "remove_dc": _response(f"x - lag(x, 1, 0.0::DOUBLE) {_T}", "0.99"),
    "slices_strided": f"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM {_X})
SELECT s.event_type, s.t AS start, CAST(k AS INTEGER) AS i, round(v.x, 6) AS x FROM a s, range(3) AS r(k) JOIN a v ON v.event_type = s.event_type AND v.t = s.t + 2 + 4 * k WHERE s.t % 4 = 0 AND s.t + 10 < s.n""",
    "moving_min": f"""SELECT event_id, CASE WHEN t < 4 OR t + 3 >= count(*) OVER (PARTITION BY event_type) THEN min(x) OVER (PARTITION BY event_type)
ELSE min(x) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) END AS y FROM {_X}""",
    "snap_crossings": f"""WITH a AS (SELECT *, CASE WHEN t = 0 OR (lag(x) {_T} < 0) <> (x < 0) THEN t END AS m FROM {_X}),
b AS (SELECT event_id, t, max(m) {_T} AS p, min(m) OVER (PARTITION BY event_type ORDER BY t DESC) AS n FROM a)
SELECT event_id, CASE WHEN n IS NULL OR t - p <= n - t THEN p ELSE n END AS snapped FROM b""",
    "rank_values": f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY x, event_id) - 1 AS rank FROM {_C}",
    "running_entropy": f"""WITH c AS (SELECT s.event_type, s.t, s.event_id, e.q, count(*)::DOUBLE / (s.t + 1) AS p FROM {_S} s JOIN {_S} e ON e.event_type = s.event_type AND e.t <= s.t GROUP BY s.event_type, s.t, s.event_id, e.q)
SELECT event_id, round(-sum(p * ln(p)), 6) AS entropy FROM c GROUP BY event_id""",
    "label_offsets": """WITH n AS (SELECT event_type, max(user_id) + 1 AS n FROM events GROUP BY 1)
SELECT event_id, user_id + CAST(coalesce((SELECT sum(n.n) FROM n WHERE n.event_type < events.event_type), 0) AS BIGINT) AS label_all FROM events""",
    "quantiles": f"SELECT event_type, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.9), 6) AS q90 FROM {_C} GROUP BY 1",
    "moments": f"SELECT event_type, round(avg(x), 6) AS mean, round(var_samp(x), 4) AS var, round(stddev_samp(x), 6) AS std FROM {_C} GROUP BY 1",
    "frame_pooling": f"""WITH a AS (SELECT event_type, t // 8 AS frame, sum(x) FILTER (t % 8 IN (0, 7)) AS e, sum(x) AS s FROM {_X} GROUP BY ALL HAVING count(*) = 8)
SELECT event_type, frame, round(e, 6) AS edge_sum, round(e / 2, 6) AS edge_mean, round(s, 6) AS sum, round(s / 8, 6) AS mean FROM a""",
    "centroids": f"SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(v[i]), 6) AS mean FROM {_E}, range(1, 65) AS r(i) GROUP BY ALL",
    "mean_l1_prop": f"""WITH a AS (SELECT t, sum(abs(o - y)) AS l, sum(abs(y)) AS s FROM {_S} GROUP BY t)
SELECT round(avg(l / CASE WHEN s < 1 THEN s + greatest(l, 1e-8::DOUBLE) ELSE s END), 6) AS loss FROM a""",
    "diff_loss": f"SELECT round(avg(abs(a - b)), 6) AS loss FROM (SELECT o - lag(o) {_T} AS a, y - lag(y) {_T} AS b FROM {_S})",
    "maximize_losses": f"SELECT (SELECT round(-avg(d), 6) FROM (SELECT stddev_samp(x) AS d FROM {_C} GROUP BY event_type)) AS std_loss, round(-avg(x), 6) AS magnitude_loss FROM {_C}",
    "cross_entropy": f"SELECT round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1]), 6) AS loss FROM {_E}",
    "angular_pairs": f"""SELECT a.vec_id, round(acos(greatest(-(1 - 5e-9::DOUBLE), least(1 - 5e-9::DOUBLE, list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-8::DOUBLE)))) / pi(), 6) AS distance
FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1""",
    "soft_max": f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(exp(v[i]) / list_sum(list_transform(v, lambda x: exp(x))), 8) AS p FROM {_E}, range(1, 65) AS r(i)",
    "glu": f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v[i] / (1 + exp(-v[i + 32])), 6) AS y FROM {_E}, range(1, 33) AS r(i)",
    "odd_reflection": f"""SELECT vec_id, CAST(i + 1 AS INTEGER) AS i, round(CASE WHEN i < 1 THEN 2 * v[1] - v[2 - i] WHEN i > 64 THEN 2 * v[64] - v[128 - i] ELSE v[i] END, 6) AS x FROM {_E}, range(-1, 67) AS r(i)""",
    "unit_conversions": """SELECT event_id, CAST(floor((event_id - 1536) / 512.0::DOUBLE) AS BIGINT) AS frames, event_id * 512 + 1536 AS samples, round(event_id / 16000.0::DOUBLE, 8) AS seconds,
CAST(trunc(event_id / 4.0::DOUBLE * 22050) AS BIGINT) AS from_seconds FROM events""",
}
