"""Segmentation: novelty of frames along the diagonal of their distances, peaks, cuts, and transients of signals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import Names, join_by, lengths, near
from .sequence import cut_labels, local_max, periods, runs, sign_changes
from .spectral import _grid, derivative, envelope
from .windows import moving_min, snap


def band_distances(df: DataFrame, source: Names, t: str, v: str, k: int) -> DataFrame:
    """(source, i, j, dist): cosine distance of frames at most ``k`` apart, i < j, by an equi-join on blocks of k; 1 where a norm is 0."""
    block = F.floor(F.col(t) / k)
    left = df.select(*source, F.col(t).alias("i"), F.col(v).alias("a"), block.alias("_b"))
    right = df.select(*source, F.col(t).alias("j"), F.col(v).alias("c"), F.explode(F.array(block, block - 1)).alias("_b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    pairs = join_by(left, right, [*source, "_b"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= k))
    norm = F.sqrt(dot("a", "a")) * F.sqrt(dot("c", "c"))
    return pairs.select(*source, "i", "j", F.when(norm == 0, 1.0).otherwise(1 - dot("a", "c") / norm).alias("dist"))


def novelty(df: DataFrame, source: Names, t: str, v: str, sizes: list[int]) -> DataFrame:
    """(source, t, score): for each size h the distances around a frame under a checkerboard of 2 h + 1 rows, less the
    least such value of the source, and the mean over sizes. Frames beyond the ends are at distance 0."""
    pairs = band_distances(df, source, t, v, 2 * max(sizes))
    curve = None
    frames = join_by(df.select(*source, t), lengths(df, source, "_n"), source)
    pairs = join_by(pairs, lengths(df, source, "_n"), source)
    for h in sizes:
        low, high = F.greatest(F.col("j") - h, F.lit(0)), F.least(F.col("i") + h, F.col("_n") - 1)
        at = pairs.where(F.col("j") - F.col("i") <= 2 * h).withColumn("_c", F.explode(F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"), F.lit(1).cast("long")))))
        weight = -F.signum((F.col("i") - F.col("_c")).cast("double")) * F.signum((F.col("j") - F.col("_c")).cast("double")) * (2.0 / (2 * h) ** 2)
        score = at.groupBy(*source, F.col("_c").alias(t)).agg(F.sum(weight * F.col("dist")).alias("_s"))
        score = join_by(frames.select(*source, t), score, [*source, t], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
        score = join_by(score, score.groupBy(*source).agg(F.min("_s").alias("_least")), source).select(*source, t, (F.col("_s") - F.col("_least")).alias("_s"))
        curve = score if curve is None else curve.unionByName(score)
    return curve.groupBy(*source, t).agg((F.sum("_s") / len(sizes)).alias("score"))


def mean_around(x: str, before: int, after: int) -> "callable":
    return lambda w: F.avg(x).over(w.rowsBetween(-before, after - 1))


def peak_candidates(df: DataFrame, source: Names, t: str, x: str, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float) -> DataFrame:
    """``df`` with ``candidate``: the largest value from ``pre_max`` back to ``post_max`` ahead (exclusive), at least ``delta`` over the mean of its surroundings."""
    reach = max(pre_max, pre_avg), max(post_max, post_avg) - 1
    d = near(df, source, t, reach[0], max(reach[1], 0), {"_top": lambda w: F.max(x).over(w.rowsBetween(-pre_max, post_max - 1)), "_mean": mean_around(x, pre_avg, post_avg)})
    return d.withColumn("candidate", (F.col(x) == F.col("_top")) & (F.col(x) >= F.col("_mean") + delta)).drop("_top", "_mean")


def per_source(df: DataFrame, source: Names, fn) -> DataFrame:
    """``fn`` on the rows of each source (all rows, if no column names one); it gives rows of the same columns."""
    if source:
        return df.groupBy(*source).applyInArrow(fn, df.schema)
    one = df.withColumn("_all", F.lit(0))
    return one.groupBy("_all").applyInArrow(lambda p: fn(p.drop_columns(["_all"])), df.schema)


def peak_pick(df: DataFrame, source: Names, t: str, x: str, pre_max: int, post_max: int, pre_avg: int, post_avg: int, delta: float, wait: int) -> DataFrame:
    """(source, t) of the candidates that are taken from the first on, each more than ``wait`` after the one before.
    Only candidates reach the tasks of their sources."""

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by(t)
        keep, last = [], None
        for k, at in enumerate(p.column(t).to_pylist()):
            if last is None or at - last > wait:
                keep.append(k)
                last = at
        return p.take(keep)

    c = peak_candidates(df, source, t, x, pre_max, post_max, pre_avg, post_avg, delta).where("candidate").select(*source, t)
    return per_source(c, source, run)


def suppress(df: DataFrame, source: Names, t: str, height: str, before: int, after: int, accept: str | None = None) -> DataFrame:
    """The rows that stay when they are taken by descending height (ties by ``t``) and a row with a taken one from
    ``before`` back to ``after`` ahead (exclusive) is left out; a row without ``accept`` is never taken."""

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by([(height, "descending"), (t, "ascending")])
        at, ok = p.column(t).to_pylist(), p.column(accept).to_pylist() if accept else None
        taken, keep = set(), []
        for k, m in enumerate(at):
            if not any(q in taken for q in range(m - before, m + after)) and (ok is None or ok[k]):
                taken.add(m)
                keep.append(k)
        return p.take(keep)

    return per_source(df, source, run)


def global_peaks(df: DataFrame, source: Names, t: str, x: str, before: int, after: int, min_strength: float = 0.02) -> DataFrame:
    """(source, t): local maxima that stand out from the moving minimum by ``min_strength`` of the source's range and are
    above the means on both sides, by descending height, none near a higher one."""
    size = before + after
    d = moving_min(df.select(*source, t, x), source, t, x, size // 2, size - size // 2 - 1, "_low")
    d = local_max(d, source, t, x, "_peak")
    d = near(d, source, t, before, after, {"_left": lambda w: F.avg(x).over(w.rowsBetween(-before, -1)), "_right": lambda w: F.avg(x).over(w.rowsBetween(0, after - 1))})
    span = df.groupBy(*source).agg((F.max(x) - F.min(x)).alias("_span"))
    d = join_by(d, span, source).where(F.col("_peak") & ((F.col(x) - F.col("_low")) / F.col("_span") >= min_strength))
    d = d.withColumn("_ok", F.coalesce((F.col(x) > F.col("_left")) & (F.col(x) > F.col("_right")), F.lit(False)))
    return suppress(d.select(*source, t, x, "_ok"), source, t, x, before, after, "_ok").select(*source, t)


def cuts(df: DataFrame, source: Names, t: str, v: str, sizes: list[int] = [6], min_dur: int = 4, min_strength: float = 0.03) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cuts of frames, the picked peaks of their novelty, and the novelty itself."""
    curve = materialize(novelty(df, source, t, v, sizes), "novelty")
    half = min_dur // 2
    picked = peak_pick(curve, source, t, "score", half, half, half, half, 0.0, min_dur)
    found = join_by(global_peaks(curve, source, t, "score", min_dur, min_dur, min_strength), lengths(df, source, "_n"), source)
    return found.where((F.col(t) > min_dur) & (F.col(t) < F.col("_n") - min_dur)).drop("_n"), picked, curve


class CutsFromNovelty:
    """``cuts`` with its parameters set once."""

    def __init__(self, sizes: list[int] = [6], min_dur: int = 4, min_strength: float = 0.03):
        self.parameters = {"sizes": sizes, "min_dur": min_dur, "min_strength": min_strength}

    def __call__(self, df: DataFrame, source: Names, t: str, v: str) -> DataFrame:
        return cuts(df, source, t, v, **self.parameters)[0]


def envelope_and_slope(df: DataFrame, source: Names, t: str, x: str, n_fft: int, overlap: int, max_lag: int) -> DataFrame:
    """(source, t, env, grad): the normalised envelope and its normalised derivative, both taken to the samples' grid linearly."""
    e = envelope(df, source, t, x, n_fft, n_fft // overlap, normalize=True, interp=False)
    e = materialize(e, "env")
    g = materialize(derivative(e, source, t, "env", max_lag, normalize=True, out="grad"), "grad")
    size = lengths(df, source, "_all")

    def spread(d: DataFrame, c: str) -> DataFrame:
        d = join_by(near(join_by(d, lengths(d, source, "_n"), source), source, t, 0, 1, {"_next": lambda w: F.lead(c).over(w)}), size, source)
        return _grid(d, source, t, c, F.col("_all"))

    return join_by(spread(e, "env"), spread(g, "grad"), [*source, t])


def attacks(level: DataFrame, source: Names, t: str, sensitivity: float = 0.0) -> DataFrame:
    """(source, period, attack, peak, score): periods of the slope whose envelope rises by more than ``sensitivity``."""
    p = periods(level, source, t, "grad")
    at = lambda c: level.select(*source, F.col(t).alias(c), F.col("env").alias(f"_{c}"))
    p = join_by(join_by(p, at("attack"), [*source, "attack"]), at("peak"), [*source, "peak"])
    p = p.withColumn("score", F.col("_peak") - F.col("_attack"))
    return p.where(F.col("score") > sensitivity).select(*source, "period", "attack", "peak", "score")


def _span_join(spans: DataFrame, level: DataFrame, source: Names, t: str, low: str, high: str, size: int = 1024) -> DataFrame:
    """Every span [low, high) with the samples in it, joined by blocks of samples."""
    s = spans.where(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))))
    d = level.withColumn("_b", F.floor(F.col(t) / size))
    return join_by(s, d, [*source, "_b"]).where((F.col(t) >= F.col(low)) & (F.col(t) < F.col(high))).drop("_b")


def sides(cuts_: DataFrame, coarse: DataFrame, fine: DataFrame, source: Names, t: str, most: int = 2000) -> DataFrame:
    """``cuts_`` with left and right: the largest lead of the coarse envelope over the fine one on each side of an attack, within
    the way to its peak and ``most``; ``side`` is 0 where the left is at least the right."""
    half = F.least(F.col("peak") - F.col("attack"), F.lit(most))
    s = cuts_.withColumns({"_l": F.greatest(F.col("attack") - half, F.lit(0)), "_m": F.col("attack"), "_r": F.col("attack") + half})
    lead = join_by(coarse.select(*source, t, F.col("env").alias("_c")), fine.select(*source, t, F.col("env").alias("_f")), [*source, t]).select(*source, t, (F.col("_c") - F.col("_f")).alias("_d"))
    key = [*source, "period"]
    for low, high, out in (("_l", "_m", "left"), ("_m", "_r", "right")):
        top = _span_join(s.select(*key, low, high), lead, source, t, low, high).groupBy(*key).agg(F.max("_d").alias(out))
        s = join_by(s, top, key, "left")
    return s.withColumn("side", F.when(F.coalesce("right", F.lit(0.0)) > F.coalesce("left", F.lit(0.0)), 1).otherwise(0)).drop("_l", "_m", "_r")


def refine(spans: DataFrame, level: DataFrame, source: Names, t: str) -> DataFrame:
    """Spans (source, period, start, stop) moved to the sample of the least 0.9 env + 0.1 (1 - grad) in them, or kept where that
    is the last one, and to the envelope's largest sample from there on; an empty span stays."""
    key = [*source, "period"]
    d = _span_join(spans, level, source, t, "start", "stop")
    cost = 0.9 * F.col("env") + 0.1 * (1 - F.col("grad"))
    best = d.groupBy(*key).agg(F.min_by(t, F.struct(cost, F.col(t))).alias("_s"), F.min_by(t, F.struct(-F.col("env"), F.col(t))).alias("_p"))
    out = join_by(spans, best, key, "left")
    start = F.when(F.col("_s").isNull() | (F.col("_s") == F.col("stop") - 1), F.col("start")).otherwise(F.col("_s"))
    return out.select(*key, start.alias("start"), F.when(F.col("_s").isNull(), F.col("stop")).otherwise(F.greatest(F.col("_p"), start)).alias("stop"))


#: Sizes (n_fft, overlap, max_lag) from coarse to fine.
LEVELS = ((8192, 32, 9), (4096, 64, 33), (2048, 32, 17), (1024, 16, 9), (512, 8, 9), (256, 8, 9))


def sample_cuts(df: DataFrame, source: Names, t: str, x: str, level: int = 0, sensitivity: float = 0.0, levels=None) -> DataFrame:
    """(source, period, cut, score): attacks of the coarsest level, refined through the finer ones and snapped to a change of sign.
    The left side of an attack is as wide as the way to its peak."""
    if not 0 <= level <= 4:
        raise ValueError("level must be from 0 to 4")
    chosen = [materialize(envelope_and_slope(df, source, t, x, *s), "level") for s in (levels or LEVELS[level:])]
    found = materialize(sides(materialize(attacks(chosen[0], source, t, sensitivity), "attacks"), chosen[0], chosen[-1], source, t), "sides")
    left = F.col("side") == 0
    spans = found.select(*source, "period", F.when(left, F.greatest(2 * F.col("attack") - F.col("peak"), F.lit(0))).otherwise(F.col("attack")).alias("start"),
                         F.when(left, F.col("attack")).otherwise(F.col("peak")).alias("stop"))
    for finer in chosen[1:]:
        spans = materialize(refine(spans, finer, source, t), "spans")
    place = snap(sign_changes(df.select(*source, t, x), source, t, x), source, t, "change", "cut").select(*source, F.col(t).alias("start"), "cut")
    out = join_by(spans, place, [*source, "start"])
    return join_by(out, found.select(*source, "period", "score"), [*source, "period"]).select(*source, "period", "cut", "score")


def sample_labels(df: DataFrame, source: Names, t: str, found: DataFrame, cut: str = "cut") -> DataFrame:
    """``df`` with ``label``: how many cuts lie up to each sample."""
    marks = found.select(*source, F.col(cut).alias(t), F.lit(True).alias("_cut")).distinct()
    return cut_labels(join_by(df, marks, [*source, t], "left"), source, t, F.coalesce("_cut", F.lit(False))).drop("_cut")


def export(df: DataFrame, source: Names, t: str, x: str, label: str, silence: int = 0) -> DataFrame:
    """(source, label, t, x): the pieces between cuts, counted from 0 each; with ``silence``, as many zeros behind each piece."""
    first = df.groupBy(*source, label).agg(F.min(t).alias("_from"), F.max(t).alias("_to"))
    pieces = join_by(df, first, [*source, label]).select(*source, label, (F.col(t) - F.col("_from")).alias(t), F.col(x).cast("double").alias(x))
    if not silence:
        return pieces
    size = F.col("_to") - F.col("_from") + 1
    zeros = first.select(*source, label, F.explode(F.sequence(size, size + silence - 1)).alias(t), F.lit(0.0).alias(x))
    return pieces.unionByName(zeros)


def segment_rows(df: DataFrame, source: Names, t: str, label: str, hop: int, sr: int) -> DataFrame:
    """source, seg_id, label and its text, with the start and end of each run of a label in seconds."""
    r = runs(df, source, t, label)
    second = lambda c: F.col(c) * hop / F.lit(float(sr))
    return r.select(*source, "seg_id", "label", F.col("label").cast("string").alias("label_text"), second("start").alias("start_time"), second("stop").alias("end_time"))


def label_set(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels in their order."""
    return df.select(label).distinct().orderBy(label)


def by_labels(df: DataFrame, label: str, labels: list) -> DataFrame:
    """The frames of a set of labels."""
    return df.where(F.col(label).isin(*labels)) if labels else df.limit(0)


def by_segments(frames: DataFrame, segments: DataFrame, source: Names, t: str, hop: int, sr: int) -> DataFrame:
    """The frames of time segments (source, start_time, end_time), each as often as it is in one; bounds are rounded to frames, halves to even."""
    at = lambda c: F.bround(F.col(c) * sr / F.lit(float(hop))).cast("long")
    s = segments.select(*source, at("start_time").alias("_start"), at("end_time").alias("_stop"))
    return _span_join(s, frames, source, t, "_start", "_stop").drop("_stop").withColumnRenamed("_start", "segment_start")


def between(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(score) > low) & (F.col(score) < high))


def guard(x: Column, name: str = "value") -> Column:
    """``x``; a value that is not a number stops the query."""
    return F.when(F.isnan(x), F.raise_error(F.lit(f"nan in {name}"))).otherwise(x)
