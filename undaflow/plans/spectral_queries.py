"""Queries on spectra of ``events``: 16 samples a frame, 8 a hop, and operators on the frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import pointwise as P
from ..operators import sequence as Q
from ..operators import spectral as S
from .signal_queries import _C, _r, samples

SRC, N, H = ["event_type"], 16, 8


def _frames(spark, d, coordinate="mag", **more):
    return S.stft(samples(spark, d), SRC, "t", "x", N, H, coordinate, **more)


def _long(df, keys, **arrays):
    """One row a component of arrays of one length."""
    z = df.select(*keys, F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])).alias("bin", "_z"))
    return z.select(*keys, "bin", *[_r(F.col(f"_z.{n}")).alias(n) for n in arrays])


def stft_cartesian(spark, d):
    return _long(_frames(spark, d, "car", center=False), ["event_type", "frame"], re="re", im="im")


def stft_polar(spark, d):
    s = _frames(spark, d, "pol", center=False, alignment="start")
    back = lambda f: F.zip_with("mag", "ang", lambda m, a: m * f(a))
    return _long(s.withColumns({"re": back(F.cos), "im": back(F.sin)}), ["event_type", "frame"], mag="mag", re="re", im="im")


def magspec(spark, d):
    return _long(_frames(spark, d), ["event_type", "frame"], mag="mag")


def istft_roundtrip(spark, d):
    s = S.istft(_frames(spark, d, "pol"), SRC, N, H)
    return s.select("event_type", "t", _r("x").alias("x"))


def istft_cartesian(spark, d):
    s = S.istft(_frames(spark, d, "car", window=None, center=False, alignment="start"), SRC, N, H, "car", center=False, window=None)
    return s.select("event_type", "t", _r("x").alias("x"))


def melspec(spark, d):
    return _long(S.mel_spec(_frames(spark, d), "mag", N, 4, 22050.0), ["event_type", "frame"], mel="mel")


def mfcc(spark, d):
    return _long(S.mfcc(S.mel_spec(_frames(spark, d), "mag", N, 4, 22050.0), "mel", 4, 3), ["event_type", "frame"], y="mfcc")


def chroma(spark, d):
    return _long(S.chroma(_frames(spark, d), "mag", N), ["event_type", "frame"], y="chroma")


def hpss(spark, d):
    h = S.hpss(_frames(spark, d), SRC, "frame", "mag", kernel=5).select("event_type", "frame", F.posexplode(F.arrays_zip("harmonic", "percussive")).alias("bin", "z"))
    return h.select("event_type", "frame", "bin", F.round("z.harmonic", 8).alias("harmonic"), F.round("z.percussive", 8).alias("percussive"))


def envelope(spark, d):
    return S.envelope(samples(spark, d), SRC, "t", "x", N, H).select("event_type", "t", _r("env").alias("env"))


def envelope_bank(spark, d):
    return _long(S.envelope_bank(samples(spark, d), SRC, "t", "x", [16, 32], [8, 16]), ["event_type", "t"], env="env")


def interpolate_linear(spark, d):
    return S.interpolate(samples(spark, d), SRC, "t", "x", factor=2).select("event_type", "t", _r("x").alias("x"))


def interpolate_previous(spark, d):
    return S.interpolate(samples(spark, d), SRC, "t", "x", length=777, mode="previous").select("event_type", "t", _r("x").alias("x"))


def derivative_lag3(spark, d):
    return S.derivative(samples(spark, d), SRC, "t", "x", 3, normalize=True).select("event_type", "t", _r("y").alias("y"))


def autoconvolve(spark, d):
    return _long(S.auto_convolve(_frames(spark, d), SRC, "frame", "mag", 3), ["event_type", "frame"], y="y")


def f0_filter(spark, d):
    return _long(S.f0_filter(_frames(spark, d), "mag"), ["event_type", "frame"], y="y")


def resample(spark, d):
    return S.resample(samples(spark, d), SRC, "t", "x", 4, 3, width=6).select("event_type", "t", _r("x").alias("x"))


def attack_release(spark, d):
    x = samples(spark, d).withColumn("x", F.abs("x"))
    return S.attack_release(x, SRC, "t", "x").select("event_type", "t", _r("level").alias("level"))


def envelope_slope(spark, d):
    return S.envelope_slope(_frames(spark, d), SRC, "frame", "mag").select("event_type", "frame", _r("env").alias("env"), _r("slope").alias("slope"))


def griffin_lim(spark, d):
    """The signal found again from magnitudes: phases are lost, so it is not the one that made them."""
    return S.griffin_lim(_frames(spark, d), SRC, N, H, n_iter=8).select("event_type", "t", _r("x").alias("x"))


def positional_encoding(spark, d):
    table = M.positions(8, 6)
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 48).alias("v"))
    rows = e.select("vec_id", F.posexplode(P.unfold(F.col("v"), 6)).alias("t", "row"))
    pos = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in table])
    return rows.select("vec_id", "t", F.posexplode(F.zip_with("row", F.get(pos, F.col("t")), lambda a, b: a + b)).alias("dim", "y")).select("vec_id", "t", "dim", _r("y").alias("y"))


def checker_kernel(spark, d):
    k = M.checker(3)
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(k) for j, x in enumerate(r)], "i int, j int, x double").select("i", "j", _r("x").alias("x"))


def frame_attacks(spark, d):
    """Periods of the envelope's derivative."""
    g = S.derivative(S.envelope(samples(spark, d), SRC, "t", "x", N, H, interp=False), SRC, "t", "env", 2)
    return Q.periods(g, SRC, "t", "y").select("event_type", "period", "attack", "peak")


QUERIES = {f.__name__: f for f in (stft_cartesian, stft_polar, magspec, istft_roundtrip, istft_cartesian, melspec, mfcc, chroma, hpss, envelope, envelope_bank, interpolate_linear, interpolate_previous, derivative_lag3,
                                   autoconvolve, f0_filter, resample, attack_release, envelope_slope, griffin_lim, positional_encoding, checker_kernel, frame_attacks)}

_T = f"(SELECT event_type, event_id, x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n FROM {_C})"
_HANN = "(0.5 - 0.5 * cos(2 * pi() * k / {n}.0))"


def _dft(signal: str, size: int = N, hop: int = H, window: str = _HANN) -> str:
    """(event_type, f, b, re, im) of a signal (event_type, u, x) counted from 0, with whole frames only."""
    return f"""(SELECT event_type, f, b, sum(v * cos(2 * pi() * b * k / {size}.0)) AS re, -sum(v * sin(2 * pi() * b * k / {size}.0)) AS im FROM
(SELECT event_type, f, k, x * {window.format(n=size)} AS v FROM (SELECT event_type, u // {hop} - o AS f, u - (u // {hop} - o) * {hop} AS k, x, max(u) OVER (PARTITION BY event_type) AS last
FROM {signal}, range({size // hop}) AS q(o)) WHERE f >= 0 AND k < {size} AND f * {hop} + {size} - 1 <= last), range({size // 2 + 1}) AS r(b) GROUP BY ALL)"""


_END = f"(SELECT event_type, t - (n - ((n - 8) // 8 * 8 + 8)) AS u, x FROM {_T} WHERE t >= n - ((n - 8) // 8 * 8 + 8))"
_START = f"(SELECT event_type, t AS u, x FROM {_T} WHERE t < (n - 8) // 8 * 8 + 8)"
#: The end of each source in whole hops, and that with zeros or mirrored samples around.
_WHOLE = f"(SELECT event_type, t - n % 8 AS u, x, n - n % 8 AS m FROM {_T} WHERE t >= n % 8)"
_ENDS = f"(SELECT event_type, max(m) AS m FROM {_WHOLE} GROUP BY 1)"
_ZEROS = f"(SELECT event_type, u + 8 AS u, x FROM {_WHOLE} UNION ALL SELECT event_type, i, 0.0 FROM {_ENDS}, range(8) AS z(i) UNION ALL SELECT event_type, m + 8 + i, 0.0 FROM {_ENDS}, range(8) AS z(i))"


def _mirrored(size: int, hop: int) -> str:
    w = f"(SELECT event_type, t - n % {hop} AS u, x, n - n % {hop} AS m FROM {_T} WHERE t >= n % {hop})"
    h = size // 2
    return f"(SELECT event_type, u + {h} AS u, x FROM {w} UNION ALL SELECT event_type, {h} - u, x FROM {w} WHERE u BETWEEN 1 AND {h} UNION ALL SELECT event_type, 2 * (m - 1) - u + {h}, x FROM {w} WHERE u BETWEEN m - 1 - {h} AND m - 2)"


_MAG = f"(SELECT event_type, f, b, sqrt(re * re + im * im) AS m FROM {_dft(_ZEROS)})"


def _env(size: int, hop: int) -> str:
    """(event_type, t, y): the normalised envelope on the samples' grid."""
    f = f"(SELECT event_type, f, sum(sqrt(re * re + im * im)) AS e FROM {_dft(_mirrored(size, hop), size, hop)} GROUP BY ALL)"
    return f"""(SELECT event_type, t, y / max(y) OVER (PARTITION BY event_type) AS y FROM (SELECT g.event_type, g.t, a.e + (coalesce(b.e, a.e) - a.e) * (g.p - floor(g.p)) AS y
FROM (SELECT event_type, t, t * (c - 1) / (n - 1)::DOUBLE AS p FROM {_T} JOIN (SELECT event_type, count(*) AS c FROM {f} GROUP BY 1) USING (event_type)) g
JOIN {f} a ON a.event_type = g.event_type AND a.f = floor(g.p) LEFT JOIN {f} b ON b.event_type = g.event_type AND b.f = floor(g.p) + 1))"""


_MELS = """(WITH p AS (SELECT i, (CASE WHEN 11025 < 1000 THEN 0 ELSE 15 + ln(11.025::DOUBLE) * 27 / ln(6.4::DOUBLE) END) * i / 5.0 AS mel FROM range(6) AS q(i)),
e AS (SELECT i, CASE WHEN mel < 15 THEN mel * 200 / 3.0 ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (mel - 15)) END AS hz FROM p)
SELECT lo.i AS k, b, greatest(0, least((b * 22050 / 16.0::DOUBLE - lo.hz) / (mid.hz - lo.hz), (hi.hz - b * 22050 / 16.0::DOUBLE) / (hi.hz - mid.hz))) * 2 / (hi.hz - lo.hz) AS w
FROM e lo JOIN e mid ON mid.i = lo.i + 1 JOIN e hi ON hi.i = lo.i + 2, range(9) AS r(b))"""
_MEL = f"(SELECT event_type, f, k, sum(m * w) AS mel FROM {_MAG} JOIN {_MELS} USING (b) GROUP BY ALL)"
_ODD = f"""(SELECT event_type, t, x, n FROM {_T} UNION ALL SELECT a.event_type, -a.t, 2 * e.x - a.x, a.n FROM {_T} a JOIN {_T} e ON e.event_type = a.event_type AND e.t = 0 WHERE a.t BETWEEN 1 AND 3
UNION ALL SELECT a.event_type, 2 * (a.n - 1) - a.t, 2 * e.x - a.x, a.n FROM {_T} a JOIN {_T} e ON e.event_type = a.event_type AND e.t = a.n - 1 WHERE a.t BETWEEN a.n - 4 AND a.n - 2)"""
_HARMONIC = "(SELECT b, i, sum(w) AS w FROM (" + " UNION ALL ".join(
    f"SELECT b, i, {sign} * greatest(0, 1 - abs(b * {h} - i)) AS w FROM range(9) AS r(b), range(9) AS s(i) WHERE b * {h} <= 8" for h, sign in (("1.0::DOUBLE", 1), ("2.0::DOUBLE", 1), ("3.0::DOUBLE", 1), ("(1 / 2.0::DOUBLE)", -1), ("(1 / 3.0::DOUBLE)", -1))) + ") GROUP BY ALL)"
_WT = f"""(SELECT event_type, f, b, m, f AS g FROM {_MAG} UNION ALL SELECT event_type, f, b, m, -1 - f FROM {_MAG} WHERE f < 2
UNION ALL SELECT a.event_type, a.f, a.b, a.m, 2 * c + 1 - a.f FROM {_MAG} a JOIN (SELECT event_type, max(f) AS c FROM {_MAG} GROUP BY 1) USING (event_type) WHERE a.f > c - 2)"""

_CHROMA = """(WITH a AS (SELECT b, CASE WHEN b = 0 THEN 12 * log2(22050 / 16.0::DOUBLE / 27.5) - 18 ELSE 12 * log2(greatest(b, 1) * 22050 / 16.0::DOUBLE / 27.5) END AS pc FROM range(10) AS r(b)),
w AS (SELECT a.b, c, a.pc, exp(-0.5 * pow(2 * ((a.pc - c + 126) % 12 - 6) / greatest(n.pc - a.pc, 1.0), 2)) AS w FROM a JOIN a n ON n.b = a.b + 1, range(12) AS s(c) WHERE a.b <= 8)
SELECT b, (c + 9) % 12 AS k, w / sqrt(sum(w * w) OVER (PARTITION BY b)) * exp(-0.5 * pow((pc / 12 - 5) / 2, 2)) AS w FROM w)"""

ORACLE = {
    "chroma": f"""WITH y AS (SELECT event_type, f, k, sum(m * w) AS y FROM {_MAG} JOIN {_CHROMA} USING (b) GROUP BY ALL), t AS (SELECT *, max(abs(y)) OVER (PARTITION BY event_type, f) AS top FROM y)
SELECT event_type, f AS frame, CAST(k AS INTEGER) AS bin, round(y / CASE WHEN top > 1.2e-38 THEN top ELSE 1 END, 6) AS y FROM t""",
    "stft_cartesian": f"SELECT event_type, f AS frame, CAST(b AS INTEGER) AS bin, round(re, 6) AS re, round(im, 6) AS im FROM {_dft(_END)}",
    "stft_polar": f"SELECT event_type, f AS frame, CAST(b AS INTEGER) AS bin, round(sqrt(re * re + im * im), 6) AS mag, round(re, 6) AS re, round(im, 6) AS im FROM {_dft(_START)}",
    "magspec": f"SELECT event_type, f AS frame, CAST(b AS INTEGER) AS bin, round(m, 6) AS mag FROM {_MAG}",
    "istft_roundtrip": f"SELECT event_type, u AS t, round(x, 6) AS x FROM {_WHOLE}",
    "istft_cartesian": f"SELECT event_type, u AS t, round(x, 6) AS x FROM {_START}",
    "melspec": f"SELECT event_type, f AS frame, CAST(k AS INTEGER) AS bin, round(mel, 6) AS mel FROM {_MEL}",
    "mfcc": f"""SELECT event_type, f AS frame, CAST(c AS INTEGER) AS bin, round(sum(mel * cos(pi() * c * (2 * k + 1) / 8.0)) * CASE WHEN c = 0 THEN sqrt(0.25::DOUBLE) ELSE sqrt(0.5::DOUBLE) END, 6) AS y
FROM {_MEL}, range(3) AS r(c) GROUP BY event_type, f, c""",
    "hpss": f"""WITH w AS MATERIALIZED (SELECT * FROM {_WT}), h AS (SELECT event_type, g, b, median(m) OVER (PARTITION BY event_type, b ORDER BY g ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM w),
m AS MATERIALIZED (SELECT * FROM {_MAG}), p AS (SELECT event_type, f, b, median(v) AS p FROM (SELECT a.event_type, a.f, a.b, c.m AS v FROM m a, range(-2, 3) AS r(o) JOIN m c ON c.event_type = a.event_type AND c.f = a.f
AND c.b = CASE WHEN a.b + o < 0 THEN -1 - (a.b + o) WHEN a.b + o > 8 THEN 17 - (a.b + o) ELSE a.b + o END) GROUP BY ALL)
SELECT m.event_type, m.f AS frame, CAST(m.b AS INTEGER) AS bin, round(m.m * CASE WHEN greatest(h, p) < 1.2e-38 THEN 0.5 ELSE h * h / (h * h + p * p) END, 8) AS harmonic,
round(m.m * CASE WHEN greatest(h, p) < 1.2e-38 THEN 0.5 ELSE p * p / (h * h + p * p) END, 8) AS percussive FROM m JOIN h ON h.event_type = m.event_type AND h.g = m.f AND h.b = m.b JOIN p ON p.event_type = m.event_type AND p.f = m.f AND p.b = m.b""",
    "envelope": f"SELECT event_type, t, round(y, 6) AS env FROM {_env(16, 8)}",
    "envelope_bank": f"SELECT event_type, t, 0::INTEGER AS bin, round(y, 6) AS env FROM {_env(16, 8)} UNION ALL SELECT event_type, t, 1::INTEGER, round(y, 6) FROM {_env(32, 16)}",
    "interpolate_linear": f"""WITH s AS (SELECT * FROM {_T}), g AS (SELECT event_type, n, unnest(range(2 * n)) AS j FROM (SELECT DISTINCT event_type, n FROM s)),
p AS (SELECT *, j * (n - 1) // (2 * n - 1) AS q FROM g)
SELECT p.event_type, j AS t, round(a.x + (coalesce(b.x, a.x) - a.x) * (j * (p.n - 1) / (2 * p.n - 1)::DOUBLE - q), 6) AS x FROM p JOIN s a ON a.event_type = p.event_type AND a.t = q LEFT JOIN s b ON b.event_type = p.event_type AND b.t = q + 1""",
    "interpolate_previous": f"SELECT event_type, j AS t, round(x, 6) AS x FROM {_T}, range(777) AS r(j) WHERE t = j * (n - 1) // 776",
    "derivative_lag3": f"""WITH o AS (SELECT * FROM {_ODD}), d AS (SELECT *, ((lead(x, 1) OVER w - lag(x, 1) OVER w) / 2 + (lead(x, 2) OVER w - lag(x, 2) OVER w) / 4 + (lead(x, 3) OVER w - lag(x, 3) OVER w) / 6) / 3 AS y FROM o WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, t, round(y / max(abs(y)) OVER (PARTITION BY event_type), 6) AS y FROM d WHERE t BETWEEN 0 AND n - 1""",
    "autoconvolve": f"""WITH p AS (SELECT *, ln(1 + coalesce(lag(m) OVER w, 1) * m * coalesce(lead(m) OVER w, 1)) AS z FROM {_MAG} WINDOW w AS (PARTITION BY event_type, b ORDER BY f))
SELECT event_type, f AS frame, CAST(b AS INTEGER) AS bin, round(z / (sum(z) OVER (PARTITION BY event_type, f) + 1e-8) * m, 6) AS y FROM p""",
    "f0_filter": f"""WITH m AS MATERIALIZED (SELECT * FROM {_MAG}), y AS (SELECT m.event_type, m.f, h.b, greatest(0, sum(m.m * h.w)) AS y FROM m JOIN {_HARMONIC} h ON h.i = m.b GROUP BY ALL)
SELECT m.event_type, m.f AS frame, CAST(m.b AS INTEGER) AS bin, round(m.m * y / (sum(y) OVER (PARTITION BY m.event_type, m.f) + 1e-8), 6) AS y FROM m JOIN y ON y.event_type = m.event_type AND y.f = m.f AND y.b = m.b""",
    "resample": f"""WITH g AS (SELECT event_type, t, x, j, j / 0.75::DOUBLE - t AS gap FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((t - 8) * 0.75) AS BIGINT)), least(CAST(floor((t + 8) * 0.75) AS BIGINT), CAST(ceil(n * 0.75) AS BIGINT) - 1) + 1)) AS j FROM {_T})),
w AS (SELECT *, CASE WHEN abs(gap) < 8 THEN (CASE WHEN abs(gap) < 1e-12 THEN 1 ELSE sin(gap * pi() * 0.75) / (gap * pi() * 0.75) END) * pow(cos(gap * pi() / 16), 2) ELSE 0 END AS w FROM g)
SELECT event_type, j AS t, round(sum(x * w) / sum(w), 6) AS x FROM w GROUP BY event_type, j""",
    "attack_release": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT event_type, t, abs(x) AS x FROM {_T}), r AS (SELECT event_type, t, 0.75::DOUBLE * x AS level FROM s WHERE t = 0
UNION ALL SELECT s.event_type, s.t, level + CASE WHEN s.x > level THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END * (s.x - level) FROM r JOIN s ON s.event_type = r.event_type AND s.t = r.t + 1) SELECT event_type, t, round(level, 6) AS level FROM r""",
    "envelope_slope": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT event_type, f AS t, sum(m) AS x FROM {_MAG} GROUP BY ALL), r AS (SELECT event_type, t, 0.75::DOUBLE * x AS level FROM s WHERE t = 0
UNION ALL SELECT s.event_type, s.t, level + CASE WHEN s.x > level THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END * (s.x - level) FROM r JOIN s ON s.event_type = r.event_type AND s.t = r.t + 1),
e AS (SELECT event_type, t, 0.1::DOUBLE * level AS env, lead(level) OVER w - lag(level) OVER w AS d FROM r WINDOW w AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, t AS frame, round(env, 6) AS env, round(0.3::DOUBLE * d, 6) AS slope FROM e WHERE d IS NOT NULL""",
    "positional_encoding": f"""SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(k AS INTEGER) AS dim, round(CAST(embedding[t * 6 + k + 1] AS DOUBLE) + CASE WHEN k % 2 = 0 THEN sin(t * exp(-ln(10000.0::DOUBLE) / 6 * k)) ELSE cos(t * exp(-ln(10000.0::DOUBLE) / 6 * (k - 1))) END, 6) AS y
FROM embeddings, range(8) AS a(t), range(6) AS b(k)""",
    "checker_kernel": "SELECT CAST(i + 3 AS INTEGER) AS i, CAST(j + 3 AS INTEGER) AS j, round(-sign(i) * sign(j) / 36.0::DOUBLE, 6) AS x FROM range(-3, 4) AS a(i), range(-3, 4) AS b(j)",
}
