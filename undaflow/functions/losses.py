"""Distances between outputs and targets as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .pointwise import dot, log_sum_exp


def mean_l1_prop(df: DataFrame, t: str, o: str, y: str, eps: float = 1e-8) -> DataFrame:
    """Mean over steps of the absolute error as a share of the target's magnitude."""
    s = df.groupBy(t).agg(F.sum(F.abs(F.col(o) - F.col(y))).alias("l"), F.sum(F.abs(y)).alias("s"))
    s = s.withColumn("s", F.when(F.col("s") < 1, F.col("s") + F.greatest("l", F.lit(eps))).otherwise(F.col("s")))
    return s.agg(F.avg(F.col("l") / F.col("s")).alias("loss"))


def diff_over_time(df: DataFrame, source: list[str], t: str, o: str, y: str) -> DataFrame:
    w = Window.partitionBy(*source).orderBy(t)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return df.select(F.abs(step(o) - step(y)).alias("d")).agg(F.avg("d").alias("loss"))


def maximize(df: DataFrame, source: list[str], o: str) -> DataFrame:
    """``std_loss``: minus the mean over sources of the standard deviation; ``magnitude_loss``: minus the mean."""
    s = df.groupBy(*source).agg(F.stddev_samp(o).alias("d"), F.sum(o).alias("s"), F.count(o).alias("n"))
    return s.agg((-F.avg("d")).alias("std_loss"), (-F.sum("s") / F.sum("n")).alias("magnitude_loss"))


def cross_entropy(df: DataFrame, logits: str, target: str) -> DataFrame:
    v = F.col(logits)
    return df.agg(F.avg(log_sum_exp(v) - F.get(v, F.col(target))).alias("loss"))


def angular_distance(a: Column, b: Column, signed: Column | bool, eps: float = 1e-8) -> Column:
    """Angle over pi, twice that where no component of any vector is negative (``signed`` false)."""
    cos = dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))
    lim = 1 - eps / 2
    return F.when(F.lit(signed) if isinstance(signed, bool) else signed, 1.0).otherwise(2.0) * F.acos(F.greatest(F.lit(-lim), F.least(F.lit(lim), cos))) / F.lit(math.pi)


def weighted_l1(df: DataFrame, batch: list[str], dim: str, o: str, y: str, eps: float = 1e-18) -> DataFrame:
    """Errors weighted by their dimension's share of all errors of the batch element, summed."""
    by = df.groupBy(*batch, dim).agg(F.sum(F.abs(F.col(o) - F.col(y))).alias("l"))
    # a dimension's errors share one weight, so the dimension's sum is enough
    e = by.groupBy(*batch).agg(F.sum(F.col("l") * F.col("l")).alias("q"), F.greatest(F.sum("l"), F.lit(eps)).alias("s"))
    return e.agg(F.sum(F.col("q") / F.col("s")).alias("loss"))


def vector_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, z: s + z))


def distance_over_time(df: DataFrame, batch: list[str], t: str, o: str, y: str, block: int = 4096) -> DataFrame:
    """Mean absolute difference between the distances of outputs and those of targets, over all pairs of steps of a
    batch element; pairs count twice, those of a step with itself once and as nothing, also where steps share a ``t``.
    Steps without an output or a target are in no pair. A task holds two blocks of a batch element's steps."""
    from ..operators.arrays import matrix
    from ..operators.blocks import join_by
    from ..operators.neighbors import STRIP, euclidean

    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    d = df.where(whole(o) & whole(y)).select(*batch, F.col(o).cast("array<double>").alias("_o"), F.col(y).cast("array<double>").alias("_y"), F.xxhash64(F.col(t)).alias("_h"))
    n = materialize(d.groupBy(*batch).agg(F.count("*").alias("_n")), "steps")
    d = join_by(d, n, batch) if batch else d.crossJoin(n)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    d = d.withColumn("_b", F.pmod("_h", blocks).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.select(*batch, F.least("_b", "_k").alias("_i"), F.greatest("_b", "_k").alias("_j"), "_b", "_o", "_y")

    def run(rows: pa.Table) -> pa.Table:
        left = np.asarray(rows.column("_b")) == rows.column("_i")[0].as_py()
        alone = rows.column("_i")[0].as_py() == rows.column("_j")[0].as_py()
        v, u = matrix(rows.column("_o")), matrix(rows.column("_y"))
        a, b, total = np.flatnonzero(left), np.flatnonzero(left if alone else ~left), 0.0
        for k in range(0, len(a), max(1, STRIP // max(1, len(b)))) if len(b) else ():
            i = a[k : k + max(1, STRIP // len(b))]
            total += np.abs(euclidean(v[i], v[b]) - euclidean(u[i], u[b])).sum()
        return pa.table({"s": [float(total if alone else 2 * total)]})

    total = d.groupBy(*batch, "_i", "_j").applyInArrow(run, "s double").agg(F.sum("s").alias("s"))
    pairs = n.agg(F.sum(F.col("_n") * F.col("_n")).alias("n"))
    return total.crossJoin(pairs).select((F.col("s") / F.nullif("n", F.lit(0))).alias("loss"))


def scaled_l1(df: DataFrame, t: str, key: Column, o: str, y: str, low: float = 0.95, high: float = 1.05, seed: int = 0) -> DataFrame:
    """``mean_l1_prop`` against targets scaled by numbers between ``low`` and ``high`` that a hash of ``key`` draws."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return mean_l1_prop(df.withColumn("_y", F.col(y) * (F.lit(low) + u * (high - low))), t, o, "_y")


def mean_2d_diff(df: DataFrame, batch: list[str], t: str, dim: str, o: str, y: str) -> DataFrame:
    """``mean_l1_prop`` of the differences along dimensions plus that of the differences along time."""
    cols = [*batch, t, dim, o, y]
    d = df.select(*cols)

    def stepped(axis: str) -> DataFrame:
        on = [c for c in (*batch, t, dim) if c != axis]
        after = d.select(*on, (F.col(axis) - 1).alias(axis), F.col(o).alias("_o"), F.col(y).alias("_y"))
        both = d.join(after, [*on, axis])
        return both.select(t, (F.col("_o") - F.col(o)).alias("o"), (F.col("_y") - F.col(y)).alias("y"))

    wide, long = (mean_l1_prop(stepped(axis), t, "o", "y") for axis in (dim, t))
    return wide.union(long).agg(F.sum("loss").alias("loss"))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def any_negative(df: DataFrame, *vectors: str) -> bool:
    """Whether any component of the columns is below zero: one partial aggregate."""
    found = [F.exists(v, lambda x: x < 0) for v in vectors]
    return bool(df.agg(F.max(F.greatest(*found) if len(found) > 1 else found[0])).first()[0])


def angular_loss(df: DataFrame, a: str, b: str, eps: float = 1e-8) -> DataFrame:
    """Mean angular distance of paired vectors; the range is halved only where a component of either side is negative."""
    return df.agg(F.avg(angular_distance(F.col(a), F.col(b), any_negative(df, a, b), eps)).alias("loss"))


def phase_loss(df: DataFrame, t: str, mag_o: str, mag_y: str, ang_o: str, ang_y: str) -> DataFrame:
    """100 times the proportional error of magnitudes plus 100 times the phase error, weighted by the target's magnitudes."""
    turn = lambda x: x - F.lit(2 * math.pi) * F.rint(x / F.lit(2 * math.pi))
    mags = mean_l1_prop(df, t, mag_o, mag_y).withColumnRenamed("loss", "a")
    e = F.abs(turn(F.col(ang_o) - F.col(ang_y)))
    angles = df.agg((F.sum(e * F.abs(mag_y)) / F.greatest(F.sum(F.abs(mag_y)), F.lit(1e-8))).alias("b"))
    return mags.crossJoin(angles).select((100 * F.col("a") + 100 * F.col("b")).alias("loss"))


def independence(weights: list[list[float]]) -> float:
    """Mean absolute difference between the Gram matrix of a layer's columns and the identity."""
    cols = list(zip(*weights))
    gram = [[sum(a * b for a, b in zip(p, q)) for q in cols] for p in cols]
    return sum(abs(g - (i == j)) for i, row in enumerate(gram) for j, g in enumerate(row)) / len(cols) ** 2


#: Objectives by name: what they compare and the aggregate that does it.
OBJECTIVES = {
    "reconstruction": ("continuous", mean_l1_prop), "mean_l1_prop": ("continuous", mean_l1_prop), "weighted_l1": ("continuous", weighted_l1), "diff_over_time": ("continuous", diff_over_time),
    "distance_over_time": ("continuous", distance_over_time), "scaled_l1": ("continuous", scaled_l1), "mean_2d_diff": ("continuous", mean_2d_diff), "maximize": ("continuous", maximize),
    "angular": ("continuous", angular_loss), "categorical_dist": ("discrete", cross_entropy),
}


def objective(name: str, kind: str):
    """The aggregate of an objective, refused where it does not fit what the target holds."""
    if name not in OBJECTIVES:
        raise KeyError(f"no objective {name!r}; there are {sorted(OBJECTIVES)}")
    wanted, fn = OBJECTIVES[name]
    if wanted != kind:
        raise TypeError(f"{name} needs a {wanted} target, not a {kind} one")
    return fn


def total_loss(terms: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """name and loss of every (target, weight, one-row loss), and their weighted sum as ``loss``."""
    out = None
    for name, weight, d in terms:
        one = d.select(F.lit(name).alias("name"), (F.col("loss") * F.lit(float(weight))).alias("loss"))
        out = one if out is None else out.union(one)
    return out.union(out.agg(F.lit("loss").alias("name"), F.sum("loss").alias("loss")))
