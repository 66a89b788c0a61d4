"""Operators on ordered sequences: ``source`` columns name a sequence, ``t`` numbers its samples 0, 1, ... (see ``blocks.indexed``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Names, indexed, join_by, lengths, near, running


def normalize(df: DataFrame, source: Names, x: str, out: str = "y", p: float = float("inf")) -> DataFrame:
    """Divide by the sequence's p-norm; a zero sequence stays. The norms come from one partial aggregate."""
    norm = F.max(F.abs(x)) if p == float("inf") else F.pow(F.sum(F.pow(F.abs(F.col(x)), F.lit(p))), F.lit(1 / p))
    norms = df.groupBy(*source).agg(norm.alias("_norm"))
    return join_by(df, norms, source).withColumn(out, F.col(x) / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)).drop("_norm")


def emphasis(df: DataFrame, source: Names, t: str, x: str, e: float, out: str = "y") -> DataFrame:
    return near(df, source, t, 1, 0, {out: lambda w: F.col(x) - e * F.lag(x, 1, 0.0).over(w)})


def difference(df: DataFrame, source: Names, t: str, x: str, out: str = "y") -> DataFrame:
    """Difference to the sample before; null at the first."""
    return near(df, source, t, 1, 0, {out: lambda w: F.col(x) - F.lag(x).over(w)})


def local_max(df: DataFrame, source: Names, t: str, x: str, out: str = "peak") -> DataFrame:
    """Larger than the sample before and at least the one after; an end sample is compared with itself outside."""
    peak = lambda w: F.coalesce((F.col(x) > F.coalesce(F.lag(x).over(w), F.col(x))) & (F.col(x) >= F.coalesce(F.lead(x).over(w), F.col(x))), F.lit(False))
    return near(df, source, t, 1, 1, {out: peak})


def zero_crossings(df: DataFrame, source: Names, t: str, x: str) -> DataFrame:
    """``up``: the sample before was negative and this one is positive; ``down``: the reverse."""
    up = lambda w: F.coalesce((F.lag(x).over(w) < 0) & (F.col(x) > 0), F.lit(False))
    down = lambda w: F.coalesce((F.lag(x).over(w) > 0) & (F.col(x) < 0), F.lit(False))
    return near(df, source, t, 1, 0, {"up": up, "down": down})


def sign_changes(df: DataFrame, source: Names, t: str, x: str, out: str = "change") -> DataFrame:
    """Where the sign bit differs from the sample before, and at the first sample."""
    return near(df, source, t, 1, 0, {out: lambda w: F.coalesce((F.lag(x).over(w) < 0) != (F.col(x) < 0), F.lit(True))})


def periods(df: DataFrame, source: Names, t: str, x: str) -> DataFrame:
    """source, period, attack, peak: a period starts where the signal turns positive from below zero; its peak is the
    last positive sample before the first turn to below zero inside it, or else the source's last sample. The
    very last step of a source is no turn."""
    turn = lambda w: (F.col(x) > 0) & (F.lead(x).over(w) < 0)
    d = near(df, source, t, 1, 1, {"_up": lambda w: (F.lag(x).over(w) < 0) & (F.col(x) > 0), "_turn": turn})
    d = join_by(d, lengths(df, source, "_n"), source)
    d = running(d, source, t, F.coalesce(F.col("_up"), F.lit(False)).cast("long"), "period").where("period > 0")
    first = F.min(F.when(F.col("_turn") & (F.col(t) < F.col("_n") - 2), F.col(t)))
    return d.groupBy(*source, "period").agg(F.min(t).alias("attack"), F.coalesce(first, F.max("_n") - 1).alias("peak"))


def runs(df: DataFrame, source: Names, t: str, label: str) -> DataFrame:
    """Maximal runs of one label: source, seg_id, label, start, stop (exclusive)."""
    new = lambda w: ((F.col(t) == 0) | ~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("long")
    d = running(near(df, source, t, 1, 0, {"_new": new}), source, t, F.col("_new"), "_seg").withColumn("seg_id", F.col("_seg") - 1)
    return d.groupBy(*source, "seg_id").agg(F.first(label).alias("label"), F.min(t).alias("start"), (F.max(t) + 1).alias("stop"))


def cut_labels(df: DataFrame, source: Names, t: str, cut: Column, out: str = "label") -> DataFrame:
    """Number of cuts up to and including each sample."""
    return running(df, source, t, F.coalesce(cut, F.lit(False)).cast("long"), out)


def tumbling(df: DataFrame, source: Names, t: str, x: str, size: int) -> DataFrame:
    """Frames of ``size`` samples, the incomplete last one left out: source, frame, v. Null samples keep their place."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x")))), lambda s: s["x"])
    return df.groupBy(*source, F.floor(F.col(t) / size).alias("frame")).agg(v.alias("v")).where(F.size("v") == size)


def dense_codes(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Labels recoded 0, 1, ... in their order; a null label has a code of its own, the first."""
    return join_by(df, indexed(df.select(label).distinct(), [], [label], out), [label])


def histogram(df: DataFrame, source: Names, x: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of equal bins on [low, high], the last edge included; values outside are left out."""
    b = F.least(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    return df.where(F.col(x).between(low, high)).groupBy(*source, b.alias("bin")).agg(F.count("*").alias("n"))


def band_pairs(df: DataFrame, t: str, v: str, k: int) -> DataFrame:
    """Cosine of vectors at most ``k`` apart (i < j), by an equi-join on blocks of k; 1 if a norm is 0."""
    block = F.floor(F.col(t) / k)
    left = df.select(F.col(t).alias("i"), F.col(v).alias("a"), block.alias("b"))
    right = df.select(F.col(t).alias("j"), F.col(v).alias("c"), F.explode(F.array(block, block - 1)).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    pairs = left.join(right, "b").where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= k))
    norm = F.sqrt(dot("a", "a")) * F.sqrt(dot("c", "c"))
    return pairs.select("i", "j", F.when(norm == 0, 1.0).otherwise(dot("a", "c") / norm).alias("cosine"))
