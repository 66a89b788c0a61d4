"""Operators along one sequence that carry state or look at neighbours: recurrences, slices, snapping, running entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Names, indexed, join_by, lengths, near, running


def recurrence(df: DataFrame, source: Names, t: str, b: str, c: float, out: str = "y", block: int = 256) -> DataFrame:
    """y[t] = b[t] + c * y[t - 1] from y = 0, ``t`` counting 0, 1, ... in each source.

    A scan by blocks: a block's response from rest is local, and the value that enters a block follows the
    same recurrence over the blocks' ends with c ** block, solved by the same function one level up."""
    n = df.agg(F.max(t)).first()[0]
    if n is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    at = f"_{t}_block"  # not the name of the level above
    d = df.withColumn(at, F.floor(F.col(t) / block).cast("long"))
    grown = F.aggregate(F.slice("_v", 2, F.size("_v")), F.slice("_v", 1, 1), lambda a, x: F.concat(a, F.array(F.struct(x["t"].alias("t"), (x["x"] + c * F.element_at(a, -1)["x"]).alias("x")))))
    local = d.groupBy(*source, at).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(b).cast("double").alias("x")))).alias("_v"))
    local = local.select(*source, at, grown.alias("_v"))
    if n < block:
        entered = local.withColumn("_in", F.lit(0.0))
    else:
        ends = local.select(*source, at, F.element_at("_v", -1)["x"].alias("_end"))
        carry = recurrence(ends, source, at, "_end", c**block, "_in", block).select(*source, (F.col(at) + 1).alias(at), "_in")
        entered = join_by(local, carry, [*source, at], "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
    rows = entered.select(*source, "_in", F.explode("_v").alias("_e"))
    rows = rows.select(*source, F.col("_e.t").alias(t), (F.col("_e.x") + F.col("_in") * F.pow(F.lit(c), F.col("_e.t") % block + 1)).alias(out))
    return join_by(df, rows, [*source, t])


def deemphasis(df: DataFrame, source: Names, t: str, x: str, e: float, out: str = "y") -> DataFrame:
    """y[t] = (1 - e) x[t] + e y[t - 1]."""
    return recurrence(df.withColumn("_b", (1 - e) * F.col(x)), source, t, "_b", e, out).drop("_b")


def remove_dc(df: DataFrame, source: Names, t: str, x: str, pole: float = 0.99, out: str = "y") -> DataFrame:
    """y[t] = x[t] - x[t - 1] + pole * y[t - 1]."""
    d = near(df, source, t, 1, 0, {"_b": lambda w: F.col(x) - F.lag(x, 1, 0.0).over(w)})
    return recurrence(d, source, t, "_b", pole, out).drop("_b")


def slices(df: DataFrame, source: Names, t: str, x: str, length: int, hop: int = 1, shift: int = 0, stride: int = 1, n: str | None = None) -> DataFrame:
    """source, start, v: the whole windows x[start + shift : start + shift + length : stride] at every ``hop``.

    Each sample goes to the windows it is in, so no row holds a window that is not kept; nulls keep their place.
    ``n`` names a column with the source's length, which is counted otherwise."""
    t_, last = F.col(t), shift + length - 1
    low = F.greatest(F.ceil((t_ - last) / F.lit(float(hop))).cast("long"), F.lit(0).cast("long"))
    high = F.floor((t_ - shift) / F.lit(float(hop))).cast("long")
    sized = df.withColumn("_n", F.col(n)) if n else join_by(df, lengths(df, source, "_n"), source)
    d = sized.select(*source, "_n", t_.alias("_t"), F.col(x).alias("_x"), F.explode(F.when(high >= low, F.sequence(low, high, F.lit(1).cast("long")))).alias("_k"))
    d = d.withColumn("start", F.col("_k") * hop).withColumn("_i", F.col("_t") - F.col("start") - shift)
    # whether the window is whole shows in its last place, also where the stride leaves that out
    d = d.where((F.col("_i") % stride == 0) & (F.col("start") + last < F.col("_n")))
    return d.groupBy(*source, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("v"))


def moving_min(df: DataFrame, source: Names, t: str, x: str, before: int, after: int, out: str = "y") -> DataFrame:
    """Least value from ``before`` rows back to ``after`` ahead; beyond the ends stands the source's own least value."""
    low = join_by(df.groupBy(*source).agg(F.min(x).alias("_least")), lengths(df, source, "_n"), source)
    d = near(df, source, t, before, after, {"_y": lambda w: F.min(x).over(w.rowsBetween(-before, after))})
    beyond = (F.col(t) < before) | (F.col(t) + after >= F.col("_n"))
    return join_by(d, low, source).withColumn(out, F.when(beyond, F.col("_least")).otherwise(F.col("_y"))).drop("_least", "_n", "_y")


def snap(df: DataFrame, source: Names, t: str, mark: str, out: str = "snapped") -> DataFrame:
    """The place of the nearest row with ``mark``, the earlier one at equal distance; null without any."""
    at = F.when(F.col(mark), F.col(t))
    d = running(running(df, source, t, at, "_b", "max"), source, t, at, "_a", "min", back=True)
    return d.withColumn(out, F.when(F.col("_a").isNull() | (F.col(t) - F.col("_b") <= F.col("_a") - F.col(t)), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")


def ranks(df: DataFrame, source: Names, x: str, key: str, out: str = "rank") -> DataFrame:
    """Place of each value in the order of values, ties by ``key``."""
    return indexed(df, source, [x, key], out)


def quantile(df: DataFrame, source: Names, x: str, shares: dict[str, float]) -> DataFrame:
    """source and one column a share: the interpolated quantile, read off the ranks; nulls take no part."""
    d = indexed(df.where(F.col(x).isNotNull()).select(*source, F.col(x).cast("double").alias("_x")), source, ["_x"], "_r")
    d = join_by(d, lengths(d, source, "_n"), source)
    out = []
    for name, q in shares.items():
        at = (F.col("_n") - 1) * F.lit(q)
        part = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_r") - at))
        out.append(F.sum(F.when(part > 0, F.col("_x") * part)).alias(name))
    keep = None
    for q in shares.values():
        one = F.abs(F.col("_r") - (F.col("_n") - 1) * F.lit(q)) < 1
        keep = one if keep is None else keep | one
    return d.where(keep).groupBy(*source).agg(*out)


def running_entropy(df: DataFrame, source: Names, t: str, symbol: str, out: str = "entropy") -> DataFrame:
    """Entropy (nats) of the symbols up to each row: ln n - sum(c ln c) / n, where a row changes one count only."""
    xlnx = lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)
    d = running(df, [*source, symbol], t, F.lit(1.0), "_c")
    d = running(d, source, t, xlnx(F.col("_c")) - xlnx(F.col("_c") - 1), "_d")
    n = F.col(t) + 1
    return d.withColumn(out, F.log(n) - F.col("_d") / n).drop("_c", "_d")


def signed_entropy(df: DataFrame, source: Names, t: str, entropy: str, out: str = "signed") -> DataFrame:
    """The entropy with the sign of its next change; the change after the last row is to zero."""
    return near(df, source, t, 0, 1, {out: lambda w: F.signum(F.lead(entropy, 1, 0.0).over(w) - F.col(entropy)) * F.col(entropy)})


def label_offsets(df: DataFrame, source: str, label: str, out: str = "label_all") -> DataFrame:
    """Labels made distinct between sources: each source starts after the largest label of those before it."""
    top = indexed(df.groupBy(source).agg((F.max(label) + 1).alias("_n")), [], [source], "_k")
    top = running(top, [], "_k", F.coalesce("_n", F.lit(0)), "_to").select(source, (F.col("_to") - F.coalesce("_n", F.lit(0))).alias("_s"))
    return join_by(df, top, [source]).withColumn(out, F.col(label) + F.col("_s")).drop("_s")


def class_size(df: DataFrame, source: Names, label: str) -> DataFrame:
    """source, class_size: one more than the largest label."""
    return df.groupBy(*source).agg((F.max(label) + 1).alias("class_size"))


def centroids(df: DataFrame, label: str, v: str) -> DataFrame:
    """label, dim, mean: the mean vector of each label, one row a component."""
    return df.select(label, F.posexplode(v).alias("dim", "_x")).groupBy(label, "dim").agg(F.avg("_x").alias("mean"))


def moments(df: DataFrame, source: Names, x: str) -> DataFrame:
    return df.groupBy(*source).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("std"))


def repeat_rate(frames: DataFrame, v: str, size: int, out: str = "rate") -> DataFrame:
    """The share of a frame's places that repeat a symbol."""
    return frames.withColumn(out, 1 - (F.size(F.array_distinct(v)) - 1) / F.lit(float(size - 1)))


def pool(frames: DataFrame, v: str, size: int) -> DataFrame:
    """edge_sum, edge_mean, sum and mean of each frame."""
    edge, total = F.get(v, F.lit(0)) + F.get(v, F.lit(size - 1)), F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return frames.withColumns({"edge_sum": edge, "edge_mean": edge / 2, "sum": total, "mean": total / size})
