"""Spectra of signals and their inverses, and operators on frames (source, frame, array).

A signal is dealt into frames by exploding each sample to the frames it is in; frames become spectra in
batches; the inverse adds overlapping frames up by place. So no task holds a sequence, but for
``griffin_lim``, which iterates over one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..session import materialize
from .arrays import apply, lists, matrix, project
from .blocks import BLOCK, Names, join_by, lengths, near, reflected
from .windows import slices

COORDINATES = {"pol": ["mag", "ang"], "car": ["re", "im"], "mag": ["mag"], "angle": ["ang"]}


def whole_hops(df: DataFrame, source: Names, t: str, n_fft: int, hop: int, center: bool, alignment: str | None) -> DataFrame:
    """The signal cut to a whole number of hops: ``end`` keeps its tail, ``start`` its head; ``t`` counts from 0 again. ``_n`` is its length."""
    extra = 0 if center else n_fft - hop
    d = join_by(df, lengths(df, source, "_n"), source)
    if alignment is None:
        return d
    target = F.floor((F.col("_n") - extra) / F.lit(float(hop))).cast("long") * hop + extra
    if alignment == "end":
        d = d.withColumn(t, F.col(t) - (F.col("_n") - target)).where(F.col(t) >= 0)
    elif alignment == "start":
        d = d.where(F.col(t) < target)
    else:
        raise ValueError(f"unknown alignment {alignment!r}")
    return d.withColumn("_n", target)


def padded(df: DataFrame, source: Names, t: str, x: str, pad: int, mode: str = "constant", n: str = "_n") -> DataFrame:
    """(source, t, x, n) with ``pad`` samples more at both ends, zeros or (``reflect``) mirrored ones; ``t`` from 0 on. The first
    sample makes the zeros of its source."""
    if mode == "reflect":
        d = reflected(df, source, t, x, pad, pad, n=n).withColumnRenamed("n", n)
    elif mode == "constant":
        places = F.concat(F.sequence(F.lit(-pad), F.lit(-1)), F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda i: i + F.col(n)))
        zeros = F.transform(places, lambda i: F.struct(i.cast("long").alias("t"), F.lit(0.0).alias("x")))
        own = F.array(F.struct(F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x")))
        d = df.select(*source, n, F.explode(F.when(F.col(t) == 0, F.concat(own, zeros)).otherwise(own)).alias("_e")).select(*source, n, F.col("_e.t").alias(t), F.col("_e.x").alias(x))
    else:
        raise ValueError(f"unknown padding {mode!r}")
    return d.withColumns({t: F.col(t) + pad, n: F.col(n) + 2 * pad})


def stft(df: DataFrame, source: Names, t: str, x: str, n_fft: int, hop: int, coordinate: str = "pol", center: bool = True,
         window: str | None = "hann", pad_mode: str = "constant", alignment: str | None = "end") -> DataFrame:
    """source, frame and the arrays of ``coordinate``: mag and ang, re and im, mag, or ang; 1 + n_fft // 2 bins each."""
    d = whole_hops(df.select(*source, t, x), source, t, n_fft, hop, center, alignment)
    if center:
        d = padded(d, source, t, x, n_fft // 2, pad_mode)
    f = slices(d, source, t, x, n_fft, hop, n="_n").withColumn("frame", (F.col("start") / hop).cast("long")).drop("start")
    w = M.window(window, n_fft)
    parts = {"mag": np.abs, "ang": np.angle, "re": np.real, "im": np.imag}

    def run(v):
        s = np.fft.rfft(v * w, axis=1)
        return tuple(parts[c](s) for c in COORDINATES[coordinate])

    return apply(f, ["v"], run, COORDINATES[coordinate])


def istft(frames: DataFrame, source: Names, n_fft: int, hop: int, coordinate: str = "pol", center: bool = True, window: str | None = "hann", out: str = "x") -> DataFrame:
    """source, t, x: frames are added up by place and divided by the sum of squared windows."""
    w = M.window(window, n_fft)

    def run(a, b):
        s = a * np.exp(1j * b) if coordinate == "pol" else a + 1j * b
        return (np.fft.irfft(s, n_fft, axis=1) * w,)

    f = apply(frames.select(*source, "frame", *COORDINATES[coordinate]), COORDINATES[coordinate], run, ["_v"])
    squares = F.array(*[F.lit(float(q)) for q in w * w])
    pad = n_fft // 2 if center else 0
    d = f.select(*source, "frame", F.posexplode(F.arrays_zip("_v", squares.alias("_q"))).alias("_i", "_s"))
    d = d.select(*source, (F.col("frame") * hop + F.col("_i") - pad).alias("t"), F.col("_s._v").alias("_v"), F.col("_s._q").alias("_q"))
    y = d.groupBy(*source, "t").agg(F.sum("_v").alias("_v"), F.sum("_q").alias("_q"))
    y = y.select(*source, "t", (F.col("_v") / F.when(F.col("_q") > np.finfo(np.float32).tiny, F.col("_q")).otherwise(1.0)).alias(out))
    if center:
        last = frames.groupBy(*source).agg(((F.max("frame")) * hop).alias("_n"))
        y = join_by(y, last, source).where((F.col("t") >= 0) & (F.col("t") < F.col("_n"))).drop("_n")
    return y


def mag_spec(df: DataFrame, source: Names, t: str, x: str, n_fft: int, hop: int, **more) -> DataFrame:
    return stft(df, source, t, x, n_fft, hop, "mag", **more)


def griffin_lim(frames: DataFrame, source: Names, n_fft: int, hop: int, n_iter: int = 32, window: str | None = "hann", momentum: float = 0.99, seed: int = 0) -> DataFrame:
    """source, t, x: a signal whose centred magnitudes come near ``mag``, from seeded random phases. One source, one task."""
    w, pad = M.window(window, n_fft), n_fft // 2
    kinds = {f.name: f for f in frames.schema.fields}

    def inverse(s):
        n = n_fft + hop * (len(s) - 1)
        y, q = np.zeros(n), np.zeros(n)
        for k, v in enumerate(np.fft.irfft(s, n_fft, axis=1) * w):
            y[k * hop : k * hop + n_fft] += v
            q[k * hop : k * hop + n_fft] += w * w
        return (y / np.where(q > 1e-30, q, 1.0))[pad : n - pad]

    def forward(y, n):
        y = np.pad(y, pad)
        return np.fft.rfft(np.stack([y[k * hop : k * hop + n_fft] * w for k in range(n)]), axis=1)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        mag = matrix(t.column("mag"))
        angle = np.exp(2j * np.pi * np.random.default_rng(seed).random(mag.shape))
        last = 0.0
        for _ in range(n_iter):
            new = forward(inverse(mag * angle), len(mag))
            angle = new - momentum / (1 + momentum) * last
            angle = angle / np.maximum(np.abs(angle), 1e-16)
            last = new
        y = inverse(mag * angle)
        first = t.slice(0, 1)
        own = {c: pa.concat_arrays([first.column(c).combine_chunks()] * 1).take(pa.array(np.zeros(len(y), np.int64))) for c in source}
        return pa.table({**own, "t": pa.array(np.arange(len(y))), "x": pa.array(y)})

    schema = ", ".join([*(f"`{c}` {kinds[c].dataType.simpleString()}" for c in source), "t long, x double"])
    return frames.select(*source, "frame", "mag").groupBy(*source).applyInArrow(run, schema)


def mel_spec(frames: DataFrame, mag: str, n_fft: int, n_mels: int = 128, rate: float = 22050.0, fmin: float = 0.0, fmax: float | None = None, htk: bool = False, out: str = "mel") -> DataFrame:
    return project(frames, mag, M.mel_filters(rate, n_fft, n_mels, fmin, fmax, htk), out)


def mfcc(frames: DataFrame, mel: str, n_mels: int, n_mfcc: int = 20, strength: int = 0, out: str = "mfcc") -> DataFrame:
    """The first cosine coefficients of the mel bands as they are, without a logarithm."""
    return project(frames, mel, M.dct(n_mfcc, n_mels) * M.lifter(n_mfcc, strength)[:, None], out)


def chroma(frames: DataFrame, mag: str, n_fft: int, n_chroma: int = 12, rate: float = 22050.0, out: str = "chroma") -> DataFrame:
    """Pitch classes of each frame, the largest 1."""
    w = M.chroma_filters(rate, n_fft, n_chroma)

    def run(s):
        c = s @ w.T
        top = np.abs(c).max(axis=1, keepdims=True)
        return (c / np.where(top > np.finfo(np.float32).tiny, top, 1.0),)

    return apply(frames, [mag], run, [out])


def hpss(frames: DataFrame, source: Names, t: str, v: str, kernel: int = 31, power: float = 2.0, margin: float = 1.0) -> DataFrame:
    """``harmonic`` and ``percussive``: the spectrum under soft masks of its medians over time and over frequency."""
    h = kernel // 2
    frames = materialize(frames.select(*source, t, v), "frames")
    bins = frames.select(*source, t, F.posexplode(v).alias("bin", "x"))
    wide = reflected(bins, [*source, "bin"], t, "x", h, h, edge=True)
    wide = wide.withColumn("_at", F.col(t) + h)
    over_time = near(wide, [*source, "bin"], "_at", h, h, {"m": lambda w: F.element_at(F.array_sort(F.collect_list("x").over(w.rowsBetween(-h, h))), h + 1)}).where(F.col(t).between(0, F.col("n") - 1))
    over_time = over_time.groupBy(*source, t).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m"))), lambda s: s["m"]).alias("_h"))
    x, n = F.col(v), F.size(v)
    mirrored = F.concat(F.reverse(F.slice(x, 1, h)), x, F.reverse(F.slice(x, n - h + 1, h)))
    d = frames.select(*source, t, v).withColumn("_w", mirrored)
    d = d.withColumn("_p", F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array_sort(F.slice("_w", i, kernel)), h + 1)))
    d = join_by(d, over_time, [*source, t])

    def masked(a, b):
        z = F.greatest(a, b * margin)
        top, low = F.pow(a / z, F.lit(power)), F.pow(b * margin / z, F.lit(power))
        return F.when(z < float(np.finfo(np.float32).tiny), 0.5 if margin == 1 else 0.0).otherwise(top / (top + low))

    one = lambda a, b: F.transform(F.arrays_zip(F.col(v).alias("s"), F.col(a).alias("a"), F.col(b).alias("b")), lambda q: q["s"] * masked(q["a"], q["b"]))
    return d.select(*source, t, one("_h", "_p").alias("harmonic"), one("_p", "_h").alias("percussive"))


def interpolate(df: DataFrame, source: Names, t: str, x: str, length: int | None = None, factor: int | None = None, mode: str = "linear") -> DataFrame:
    """source, t, x at ``length`` (or ``factor`` times as many) points evenly from the first sample to the last.
    ``previous`` takes the sample before a point. Each sample makes the points up to the next one."""
    if mode not in ("linear", "previous"):
        raise ValueError(f"unknown mode {mode!r}")
    if length is None and factor is None:
        raise ValueError("a length or a factor is needed")
    d = join_by(df.select(*source, t, F.col(x).cast("double").alias(x)), lengths(df, source, "_n"), source)
    d = near(d, source, t, 0, 1, {"_next": lambda w: F.lead(x).over(w)})
    m = F.lit(length).cast("long") if length is not None else F.col("_n") * factor
    return _grid(d, source, t, x, m, mode)


def _grid(d: DataFrame, source: Names, t: str, x: str, m, mode: str = "linear") -> DataFrame:
    """The points of a grid of ``m`` between samples that carry ``_next`` and ``_n``."""
    step, span = (m - 1), F.greatest(F.col("_n") - 1, F.lit(1))
    up = lambda k: F.floor((k * step + span - 1) / span).cast("long")
    last = F.col(t) == F.col("_n") - 1
    low, high = up(F.col(t)), F.when(last, step).otherwise(up(F.col(t) + 1) - 1)
    d = d.withColumn("_m", m).select("*", F.explode(F.when(high >= low, F.sequence(low, high, F.lit(1).cast("long")))).alias("_j"))
    part = F.col("_j") * span / F.greatest(step, F.lit(1)) - F.col(t)
    y = F.col(x) if mode == "previous" else F.when(F.col("_next").isNull(), F.col(x)).otherwise(F.col(x) + (F.col("_next") - F.col(x)) * part)
    return d.select(*source, F.col("_j").alias(t), y.alias(x))


def envelope(df: DataFrame, source: Names, t: str, x: str, n_fft: int, hop: int, normalize: bool = True, window: str | None = "hann", interp: bool = True, out: str = "env") -> DataFrame:
    """source, t, env: the sum of magnitudes of each frame, taken to the samples' grid, over its largest."""
    f = mag_spec(df, source, t, x, n_fft, hop, center=True, window=window, pad_mode="reflect")
    f = materialize(f.select(*source, F.col("frame").alias(t), F.aggregate("mag", F.lit(0.0), lambda a, m: a + m).alias(out)), "envelope")
    if interp:
        d = join_by(f, lengths(f, source, "_n"), source)
        d = join_by(near(d, source, t, 0, 1, {"_next": lambda w: F.lead(out).over(w)}), lengths(df, source, "_all"), source)
        f = _grid(d, source, t, out, F.col("_all"))
    if normalize:
        top = f.groupBy(*source).agg(F.max(out).alias("_top"))
        f = join_by(f, top, source).withColumn(out, F.col(out) / F.col("_top")).drop("_top")
    return f


def envelope_bank(df: DataFrame, source: Names, t: str, x: str, n_fft: list[int], hop: list[int], normalize: bool = True) -> DataFrame:
    """source, t, env: one envelope a pair of sizes, as an array."""
    out = None
    for k, (n, h) in enumerate(zip(n_fft, hop)):
        e = envelope(df, source, t, x, n, h, normalize, out=f"_e{k}")
        out = e if out is None else join_by(out, e, [*source, t])
    return out.select(*source, t, F.array(*[f"_e{k}" for k in range(len(n_fft))]).alias("env"))


def derivative(df: DataFrame, source: Names, t: str, x: str, max_lag: int = 3, normalize: bool = False, out: str = "y") -> DataFrame:
    """source, t, y: the mean over lags L of (x[t + L] - x[t - L]) / 2 L, beyond the ends mirrored through the end samples."""
    d = reflected(df, source, t, x, max_lag, max_lag, odd=True).withColumn("_at", F.col(t) + max_lag)
    slope = lambda w: sum((F.lead(x, k).over(w) - F.lag(x, k).over(w)) / (2 * k) for k in range(1, max_lag + 1)) / max_lag
    d = near(d, source, "_at", max_lag, max_lag, {out: slope}).where(F.col(t).between(0, F.col("n") - 1)).select(*source, t, out)
    if normalize:
        top = d.groupBy(*source).agg(F.max(F.abs(out)).alias("_top"))
        d = join_by(d, top, source).withColumn(out, F.col(out) / F.col("_top")).drop("_top")
    return d


def auto_convolve(frames: DataFrame, source: Names, t: str, v: str, size: int = 3, out: str = "y") -> DataFrame:
    """Each bin times log(1 + product over ``size`` frames around), as a share of the frame's sum."""
    h = size // 2
    d = near(frames, source, t, h, size - 1 - h, {"_w": lambda w: F.collect_list(v).over(w.rowsBetween(-h, size - 1 - h))})
    product = F.aggregate(F.slice("_w", 2, size), F.element_at("_w", 1), lambda a, b: F.zip_with(a, b, lambda p, q: p * q))
    d = d.withColumn("_z", F.transform(product, lambda p: F.log(1 + p)))
    total = F.aggregate("_z", F.lit(0.0), lambda a, z: a + z) + 1e-8
    return d.withColumn("_s", total).withColumn(out, F.zip_with("_z", F.col(v), lambda z, s: z / F.col("_s") * s)).drop("_w", "_z", "_s")


def f0_filter(frames: DataFrame, v: str, overtones: int = 4, undertones: int = 4, soft: bool = True, normalize: bool = True, out: str = "y") -> DataFrame:
    """The spectrum weighted by how far its harmonics outweigh its sub-harmonics."""

    def run(s):
        a = s @ M.harmonic_sum(s.shape[1], overtones, undertones).T
        y = np.maximum(a, 0) if soft else (a > 0).astype(float)
        if normalize:
            y = y / (y.sum(axis=1, keepdims=True) + 1e-8)
        return (s, s * y)

    return apply(frames, [v], run, [v, out])


def attack_release(df: DataFrame, source: Names, t: str, x: str, attack: float = 0.75, release: float = 0.1, out: str = "level", block: int = BLOCK) -> DataFrame:
    """source, t, level: a level that goes to each sample by ``attack`` upwards and by ``release`` downwards, from 0.

    Each step shrinks the difference between two levels to at most 1 - min(attack, release) of it, so a block that
    starts from 0 enough samples earlier gives the same level up to the rounding of a double (2**-60 of the range)."""
    slow = min(attack, release)
    if not 0 < slow <= 1:
        raise ValueError("attack and release must be above 0 and at most 1")
    warm = 1 if slow == 1 else math.ceil(60 * math.log(2) / -math.log1p(-slow))
    block = max(block, warm)
    home = F.floor(F.col(t) / block)
    homes = F.array_compact(F.array(home, F.when(F.pmod(F.col(t), F.lit(block)) >= block - warm, home + 1)))

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by(t)
        level, y = 0.0, []
        for v in p.column(x).to_pylist():
            level += (attack if v > level else release) * (v - level)
            y.append(level)
        p = p.append_column(out, pa.array(y, pa.float64()))
        first = p.column("_block")[0].as_py() * block
        return p.filter(pc.greater_equal(p.column(t), first)).drop_columns(["_block"])

    d = df.select(*source, t, F.col(x).cast("double").alias(x))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return d.withColumn("_block", F.explode(homes)).groupBy(*source, "_block").applyInArrow(run, f"{schema}, `{out}` double")


def envelope_slope(frames: DataFrame, source: Names, t: str, v: str) -> DataFrame:
    """source, t, env, slope: a tenth of the followed sum of magnitudes, and three times its difference over two frames,
    for the frames that have both neighbours."""
    d = frames.select(*source, t, F.aggregate(F.transform(v, F.abs), F.lit(0.0), lambda a, m: a + m).alias("_x"))
    d = attack_release(d, source, t, "_x").withColumn("env", 0.1 * F.col("level"))
    d = near(d, source, t, 1, 1, {"slope": lambda w: 3 * (F.lead("env").over(w) - F.lag("env").over(w))})
    return d.where(F.col("slope").isNotNull()).select(*source, t, "env", "slope")


def resample(df: DataFrame, source: Names, t: str, x: str, old: int, new: int, width: int = 16) -> DataFrame:
    """source, t, x at rate ``new``: a windowed sine kernel of ``width`` zero crossings a side. Each sample adds
    to the new samples in its reach, which sum up by place; gain is restored by the kernel's own sum."""
    low = min(1.0, new / old)
    reach = width / low
    d = join_by(df.select(*source, t, x), lengths(df, source, "_n"), source)
    ratio = new / old
    first, last = F.ceil((F.col(t) - reach) * ratio), F.floor((F.col(t) + reach) * ratio)
    most = F.ceil(F.col("_n") * ratio) - 1
    d = d.withColumn("_j", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.greatest(F.least(last, most), F.lit(0)).cast("long"))))
    gap = F.col("_j") / F.lit(ratio) - F.col(t)
    arg = gap * (np.pi * low)
    weight = F.when(F.abs(arg) < 1e-12, 1.0).otherwise(F.sin(arg) / arg) * F.pow(F.cos(gap * (np.pi / (2 * reach))), F.lit(2.0))
    d = d.withColumn("_w", F.when(F.abs(gap) < reach, weight).otherwise(0.0))
    y = d.groupBy(*source, F.col("_j").alias(t)).agg(F.sum(F.col(x) * F.col("_w")).alias("_s"), F.sum("_w").alias("_g"))
    return y.select(*source, t, (F.col("_s") / F.when(F.abs("_g") > 1e-12, F.col("_g")).otherwise(1.0)).alias(x))
