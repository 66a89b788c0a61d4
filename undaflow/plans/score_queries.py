"""Queries on functions of arrays, losses, units and configurations over ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import pointwise as P
from ..functions import units as U
from ..operators import generate as G
from .signal_queries import _r, samples, signal
from .window_queries import _E, _X, _embeddings


def _pairs(spark, d):
    """Each vector beside the one of the next key."""
    e = _embeddings(spark, d)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


def _long(df, **arrays):
    z = df.select("vec_id", F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])).alias("i", "_z"))
    return z.select("vec_id", "i", *[_r(F.col(f"_z.{n}")).alias(n) for n in arrays])


def elementwise(spark, d):
    x = F.col("x")
    return signal(spark, d).select("event_id", P.identity(x).alias("same"), P.activation("Abs")(x).alias("abs"), _r(P.activation("sin")(x)).alias("sin"), _r(P.activation("cos")(x)).alias("cos"), _r(P.principal_angle(x)).alias("angle"))


def scaled_activation(spark, d):
    p = _pairs(spark, d).withColumn("s", F.transform("u", lambda x: F.abs(x) + 0.5))
    return _long(p.withColumns({"a": P.scaled(F.tanh, F.col("v"), F.col("s")), "b": P.scaled(F.tanh, F.col("v"), F.col("s"), F.col("u"))}), fixed="a", rated="b")


def phase_activations(spark, d):
    p = _pairs(spark, d)
    return _long(p.withColumns({"a": P.phase_cos_tanh(F.col("v"), F.col("u")), "b": P.phase_cos(F.col("v"), F.col("u")), "c": F.transform("v", P.phase_tanh)}), a="a", b="b", c="c")


def split_parts(spark, d):
    e = _embeddings(spark, d).withColumns({"s": P.split_sum(F.col("v"), 4, 64), "p": P.split(F.col("v"), 4, 64)})
    return _long(e.withColumn("third", F.get("p", F.lit(2))), total="s", third="third")


def reshaped(spark, d):
    """64 components as 8 rows of 8, transposed and flattened."""
    e = _embeddings(spark, d).withColumn("m", P.transpose(P.unfold(F.col("v"), 8), 8))
    return _long(e.withColumn("f", F.flatten("m")), x="f")


def padded_arrays(spark, d):
    """A prompt with blanks, parts that are filled, and causal padding on both sides."""
    e = _embeddings(spark, d).withColumn("h", F.slice("v", 1, 3))
    made = {"prompt": P.prompt(F.col("h"), 2), "filled": P.fill(F.col("h"), ("data", 5), ("blank", 1), (0.5, 1)), "left": P.causal_pad(F.col("h"), 2), "right": P.causal_pad(F.col("h"), -2)}
    return _long(e.withColumns(made), **{n: n for n in made})


def tied_mix(spark, d):
    p = _pairs(spark, d)
    parts = [F.col("v"), F.col("u")]
    made = {"total": P.unfolded_mix(parts), "mean": P.unfolded_mix(parts, reduce="mean"), "mix": P.unfolded_mix(parts, [0.0, 1.0], "mix")}
    return _long(p.withColumns(made), **{n: n for n in made})


def linear_layer(spark, d):
    e = _embeddings(spark, d).withColumn("y", P.affine(F.slice("v", 1, 4), [[0.5, -1.0, 2.0, 0.25], [1.0, 1.0, 1.0, 1.0]], [0.1, -0.2]))
    return _long(e, y="y")


def alaw_normalised(spark, d):
    """Samples over 1 in size, so each source is normalised first."""
    x = signal(spark, d).withColumn("x", F.col("x") / 100)
    return P.a_law_compress_sequence(x, ["event_type"], "x").select("event_id", "q")


def all_conversions(spark, d):
    t, s, f, sec, step = F.col("event_id"), U.Sample(16000), U.Frame(2048, 512), U.Second(), U.Step()
    padded = U.Frame(2048, 512, True)
    made = {
        "sample_frame": U.convert(t, s, f), "sample_frame_length": U.convert(t, s, f, True), "sample_padded": U.convert(t, s, padded, True), "sample_sample": U.convert(t, s, U.Sample(8000)), "sample_step": U.convert(t, s, step),
        "frame_sample": U.convert(t, f, s), "frame_sample_length": U.convert(t, f, s, True), "padded_sample": U.convert(t, padded, s, True), "frame_frame": U.convert(t, f, f), "padded_frame": U.convert(t, padded, padded), "padded_step": U.convert(t, padded, step),
        "frame_second": F.round(U.convert(t, f, U.Second(16000), True), 8), "sample_second": F.round(U.convert(t, s, sec), 8), "second_sample": U.convert(t / 4, U.Second(22050), U.Sample()), "second_frame": U.convert(t / 4, U.Second(22050), f, True),
        "second_second": t / 4, "step_step": U.convert(t, step, step), "step_sample": U.convert(t, step, s),
    }
    return signal(spark, d).select("event_id", *[c.alias(n) for n, c in made.items()])


def weighted_l1(spark, d):
    p = _pairs(spark, d).select("label", F.posexplode(F.arrays_zip("v", "u")).alias("dim", "z"))
    return L.weighted_l1(p.select("label", "dim", F.col("z.v").alias("v"), F.col("z.u").alias("u")), ["label"], "dim", "v", "u").select(F.round("loss", 5).alias("loss"))


def distance_over_time(spark, d):
    return L.distance_over_time(_pairs(spark, d), ["label"], "vec_id", "v", "u").select(_r("loss").alias("loss"))


def mean_2d_diff(spark, d):
    p = _pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip("v", "u")).alias("dim", "z"))
    return L.mean_2d_diff(p.select("vec_id", "dim", F.col("z.v").alias("v"), F.col("z.u").alias("u")), [], "vec_id", "dim", "v", "u").select(_r("loss").alias("loss"))


def cosine_pairs(spark, d):
    return _pairs(spark, d).select("vec_id", _r(L.cosine(F.col("v"), F.col("u"))).alias("cosine"))


def angular_loss(spark, d):
    """Signed vectors, and their absolute values, whose angles count double."""
    p = _pairs(spark, d).withColumns({"a": F.transform("v", F.abs), "b": F.transform("u", F.abs)})
    one, two = L.angular_loss(p, "v", "u"), L.angular_loss(p, "a", "b")
    return one.select(F.lit("signed").alias("kind"), _r("loss").alias("loss")).union(two.select(F.lit("positive"), _r("loss")))


def phase_loss(spark, d):
    p = _pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip("v", "u")).alias("dim", "z"))
    p = p.select("vec_id", F.abs("z.v").alias("mo"), F.abs("z.u").alias("my"), (F.col("z.v") * 9).alias("ao"), (F.col("z.u") * 9).alias("ay"))
    return L.phase_loss(p, "vec_id", "mo", "my", "ao", "ay").select(F.round("loss", 5).alias("loss"))


def scaled_l1(spark, d):
    """Targets scaled by hashed draws; with bounds of 1 and 1 it is the plain loss."""
    x = samples(spark, d).withColumn("y", F.col("x") / 2)
    one = L.scaled_l1(x, "t", F.col("event_id"), "x", "y", 1.0, 1.0)
    return one.select(_r("loss").alias("loss"))


def objectives_total(spark, d):
    """Two objectives by name, weighted and added up."""
    p = _pairs(spark, d)
    x = p.select("vec_id", F.posexplode(F.arrays_zip("v", "u")).alias("dim", "z")).select("vec_id", F.col("z.v").alias("v"), F.col("z.u").alias("u"))
    terms = [("magnitudes", 2.0, L.objective("reconstruction", "continuous")(x, "vec_id", "v", "u")), ("symbols", 0.5, L.objective("categorical_dist", "discrete")(p, "v", "label"))]
    return L.total_loss(terms).select("name", _r("loss").alias("loss"))


def sampled_categories(spark, d):
    """The largest logit's place, and the place that a number in [0, 1) draws at a temperature."""
    e = _embeddings(spark, d).withColumn("u", F.col("vec_id") % 97 / 97.0)
    return e.select("vec_id", G.sample_categories(F.col("v")).alias("top"), G.sample_categories(F.col("v"), 0.1, F.col("u")).alias("drawn"))


def votes(spark, d):
    return _long(_pairs(spark, d).withColumn("y", G.vote([F.col("v"), F.col("u")], [0.25, 0.75])), y="y")


def tier_cadence(spark, d):
    made = G.cadence(F.col("t"), [16, 8, 2])
    cols = [c.alias(n) for k, (a, b) in enumerate(made) for c, n in ((a, f"runs_{k}"), (b, f"reads_{k}"))]
    return samples(spark, d).select("event_id", *cols)


def name_functions(spark, d):
    """Kinds of file by name, run and epoch of a path, and the hash of a configuration."""
    name = F.concat(F.lit("/data/.x/id=run"), F.col("user_id").cast("string"), F.lit("/epoch="), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 3 == 0, ".WAV").when(F.col("event_id") % 3 == 1, ".ckpt").otherwise(".h5"))
    p = signal(spark, d).withColumn("path", name)
    from ..sources.wav import SOUND

    return p.select("event_id", F.lower("path").rlike(SOUND).alias("sound"), F.regexp_extract("path", "id=([^/]+)", 1).alias("run"), F.regexp_extract("path", r"epoch=(\d+)", 1).cast("long").alias("epoch"), F.substring(F.sha2("path", 256), 1, 8).alias("config_id"))


QUERIES = {f.__name__: f for f in (elementwise, scaled_activation, phase_activations, split_parts, reshaped, padded_arrays, tied_mix, linear_layer, alaw_normalised, all_conversions, weighted_l1, distance_over_time, mean_2d_diff,
                                   cosine_pairs, angular_loss, phase_loss, scaled_l1, objectives_total, sampled_categories, votes, tier_cadence, name_functions)}

_P = f"(SELECT a.vec_id, a.label, a.v, b.v AS u FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1)"
_D = f"(SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS i, v[k] AS v, u[k] AS u FROM {_P}, range(1, 65) AS r(k))"
_A = "(1 + ln(87.6::DOUBLE))"
_COS = "list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 1e-8::DOUBLE)"


def _prop(table: str, key: str) -> str:
    return f"(SELECT avg(l / CASE WHEN s < 1 THEN s + greatest(l, 1e-8::DOUBLE) ELSE s END) AS loss FROM (SELECT {key}, sum(abs(o - y)) AS l, sum(abs(y)) AS s FROM {table} GROUP BY {key}))"


def _angular(a: str, b: str, factor: int) -> str:
    return f"{factor} * acos(greatest(-(1 - 5e-9::DOUBLE), least(1 - 5e-9::DOUBLE, {_COS.format(a=a, b=b)}))) / pi()"


ORACLE = {
    "elementwise": f"SELECT event_id, x AS same, abs(x) AS abs, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos, round(x - 2 * pi() * round_even(x / (2 * pi()), 0), 6) AS angle FROM {_X}",
    "scaled_activation": f"SELECT vec_id, i, round(tanh(v / s) * s, 6) AS fixed, round(tanh(u * v / s) * s, 6) AS rated FROM (SELECT *, abs(u) + 0.5 AS s FROM {_D})",
    "phase_activations": f"SELECT vec_id, i, round(cos(tanh(v) * u) * pi() / 2, 6) AS a, round(cos(v * u) * pi() / 2, 6) AS b, round(tanh(v) * pi() / 2, 6) AS c FROM {_D}",
    "split_parts": f"SELECT vec_id, CAST(k - 1 AS INTEGER) AS i, round(v[k] + v[k + 16] + v[k + 32] + v[k + 48], 6) AS total, round(v[k + 32], 6) AS third FROM {_E}, range(1, 17) AS r(k)",
    "reshaped": f"SELECT vec_id, CAST(8 * a + b AS INTEGER) AS i, round(v[8 * b + a + 1], 6) AS x FROM {_E}, range(8) AS p(a), range(8) AS q(b)",
    "padded_arrays": f"""SELECT vec_id, CAST(k AS INTEGER) AS i, round(CASE WHEN k < 3 THEN v[k + 1] ELSE 0 END, 6) AS prompt, round(CASE WHEN k < 3 THEN v[k + 1] WHEN k = 3 THEN 0 ELSE 0.5 END, 6) AS filled,
round(CASE WHEN k < 2 THEN 0 ELSE v[k - 1] END, 6) AS "left", round(CASE WHEN k < 3 THEN v[k + 1] ELSE 0 END, 6) AS "right" FROM {_E}, range(5) AS r(k)""",
    "tied_mix": f"SELECT vec_id, i, round(v + u, 6) AS total, round((v + u) / 2, 6) AS mean, round(v / (1 + exp(1::DOUBLE)) + u * exp(1::DOUBLE) / (1 + exp(1::DOUBLE)), 6) AS mix FROM {_D}",
    "linear_layer": f"SELECT vec_id, 0::INTEGER AS i, round(0.5 * v[1] - v[2] + 2 * v[3] + 0.25 * v[4] + 0.1, 6) AS y FROM {_E} UNION ALL SELECT vec_id, 1::INTEGER, round(v[1] + v[2] + v[3] + v[4] - 0.2, 6) FROM {_E}",
    "alaw_normalised": f"""SELECT event_id, CAST(greatest(0, least(255, ceil((sign(y) * CASE WHEN abs(y) < 1 / 87.6::DOUBLE THEN 87.6::DOUBLE * abs(y) / {_A} ELSE (1 + ln(87.6::DOUBLE * abs(y))) / {_A} END + 1) / 2 * 255))) AS BIGINT) AS q
FROM (SELECT event_id, x / 100 / CASE WHEN max(abs(x / 100)) OVER (PARTITION BY event_type) > 1 THEN max(abs(x / 100)) OVER (PARTITION BY event_type) ELSE 1 END AS y FROM {_X})""",
    "all_conversions": """SELECT event_id, CAST(floor(event_id / 512.0::DOUBLE) AS BIGINT) AS sample_frame, CAST(floor((event_id - 1536) / 512.0::DOUBLE) AS BIGINT) AS sample_frame_length, CAST(floor(event_id / 512.0::DOUBLE) AS BIGINT) AS sample_padded,
event_id AS sample_sample, event_id AS sample_step, event_id * 512 AS frame_sample, event_id * 512 + 1536 AS frame_sample_length, (event_id - 1) * 512 AS padded_sample, event_id AS frame_frame, event_id - 1 AS padded_frame, event_id - 1 AS padded_step,
round((event_id * 512 + 1536) / 16000.0::DOUBLE, 8) AS frame_second, round(event_id / 16000.0::DOUBLE, 8) AS sample_second, CAST(trunc(event_id / 4.0::DOUBLE * 22050) AS BIGINT) AS second_sample,
CAST(floor((trunc(event_id / 4.0::DOUBLE * 22050) - 1536) / 512.0::DOUBLE) AS BIGINT) AS second_frame, event_id / 4.0::DOUBLE AS second_second, event_id AS step_step, event_id AS step_sample FROM events""",
    "weighted_l1": f"SELECT round(sum(l * l / s), 5) AS loss FROM (SELECT l, sum(l) OVER (PARTITION BY label) AS s FROM (SELECT label, i, sum(abs(v - u)) AS l FROM {_D} GROUP BY ALL))",
    "distance_over_time": f"""SELECT round(avg(abs(list_distance(a.v, b.v) - list_distance(a.u, b.u))), 6) AS loss FROM {_P} a JOIN {_P} b ON a.label = b.label""",
    "mean_2d_diff": f"""WITH d AS (SELECT vec_id, i, v, u FROM {_D}), w AS (SELECT a.vec_id, b.v - a.v AS o, b.u - a.u AS y FROM d a JOIN d b ON b.vec_id = a.vec_id AND b.i = a.i + 1),
h AS (SELECT a.vec_id, b.v - a.v AS o, b.u - a.u AS y FROM d a JOIN d b ON b.vec_id = a.vec_id + 1 AND b.i = a.i) SELECT round((SELECT loss FROM {_prop('w', 'vec_id')}) + (SELECT loss FROM {_prop('h', 'vec_id')}), 6) AS loss""",
    "cosine_pairs": f"SELECT vec_id, round({_COS.format(a='v', b='u')}, 6) AS cosine FROM {_P}",
    "angular_loss": f"""SELECT 'signed' AS kind, round(avg({_angular('v', 'u', 1)}), 6) AS loss FROM {_P}
UNION ALL SELECT 'positive', round(avg({_angular('a', 'b', 2)}), 6) FROM (SELECT list_transform(v, lambda x: abs(x)) AS a, list_transform(u, lambda x: abs(x)) AS b FROM {_P})""",
    "phase_loss": f"""WITH d AS (SELECT vec_id, abs(v) AS o, abs(u) AS y, 9 * v - 9 * u AS e FROM {_D})
SELECT round(100 * (SELECT loss FROM {_prop('d', 'vec_id')}) + 100 * (SELECT sum(abs(e - 2 * pi() * round_even(e / (2 * pi()), 0)) * y) / sum(y) FROM d), 5) AS loss""",
    "scaled_l1": f"SELECT round(loss, 6) AS loss FROM {_prop(f'(SELECT t, x AS o, x / 2 AS y FROM {_X})', 't')}",
    "objectives_total": f"""WITH t AS (SELECT 'magnitudes' AS name, 2 * loss AS loss FROM {_prop(f'(SELECT vec_id, v AS o, u AS y FROM {_D})', 'vec_id')}
UNION ALL SELECT 'symbols', 0.5 * avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1]) FROM {_P}) SELECT name, round(loss, 6) AS loss FROM t UNION ALL SELECT 'loss', round(sum(loss), 6) FROM t""",
    "sampled_categories": f"""WITH p AS (SELECT vec_id, k, sum(exp((v[k] - list_max(v)) / 0.1)) OVER (PARTITION BY vec_id ORDER BY k) / sum(exp((v[k] - list_max(v)) / 0.1)) OVER (PARTITION BY vec_id) AS c FROM {_E}, range(1, 65) AS r(k))
SELECT e.vec_id, CAST(list_position(any_value(v), list_max(any_value(v))) - 1 AS BIGINT) AS top, least(63, count(*) FILTER (c <= e.vec_id % 97 / 97.0::DOUBLE)) AS drawn FROM {_E} e JOIN p USING (vec_id) GROUP BY e.vec_id""",
    "votes": f"SELECT vec_id, i, round(0.25 * v + 0.75 * u, 6) AS y FROM {_D}",
    "tier_cadence": f"SELECT event_id, t % 16 = 0 AS runs_0, t // 16 % 1 AS reads_0, t % 8 = 0 AS runs_1, t // 8 % 2 AS reads_1, t % 2 = 0 AS runs_2, t // 2 % 4 AS reads_2 FROM {_X}",
    "name_functions": """SELECT event_id, event_id % 3 = 0 AS sound, 'run' || user_id AS run, event_id % 9 AS epoch,
substr(sha256('/data/.x/id=run' || user_id || '/epoch=' || event_id % 9 || CASE event_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.ckpt' ELSE '.h5' END), 1, 8) AS config_id FROM events""",
}
