"""Operator 7: mixing sources to target weights by Poisson replication, in DataFrame functions only.

Rows per source come from one aggregate with partial sums; sources that no target names share one
group, so at most ``len(targets) + 1`` counts reach the driver. A document's number of copies is the
inverse Poisson distribution at a uniform hash of its key; a rate above 8 is split into equal parts
whose draws are added, which is again Poisson. No row is joined, so a hot source costs nothing.

Cases: a null source belongs to the other sources; a null key hashes as the empty string; rows of one
key get the same count; nothing is drawn from an empty table or a group of weight 0; the input's columns come
out inside one struct, so none of their names clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 8.0
OTHER = "\x00other"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: float) -> list[float]:
    p, s, out, k = math.exp(-mean), 0.0, [], 0
    while mean > 0 and (k <= mean or p > 1e-18):
        s += p
        out.append(s)
        k += 1
        p *= mean / k
    return out


def _invert(cdf: Column, u: Column) -> Column:
    return F.size(F.filter(cdf, lambda c: u >= c))


def rates(df: DataFrame, source: str, targets: dict[str, float], other: float, size: float) -> dict[str, float]:
    """Mean repetitions of each group, such that the expected output is ``size`` times the input in the target shares."""
    n = {r["g"]: r["n"] for r in df.select(group(df[source], targets).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}
    weight = {**targets, OTHER: other}
    total, whole = sum(n.values()), sum(weight[g] for g in n)
    return {g: weight[g] / whole * size * total / c for g, c in n.items()} if whole else {}


def group(source: Column, targets: dict[str, float]) -> Column:
    return F.when(source.isin(*targets), source).otherwise(F.lit(OTHER)) if targets else F.lit(OTHER)


def mix(df: DataFrame, targets: dict[str, float], other: float = 1.0, size: float = 1.0, seed: int = 17, source: str = "source", key: str = "doc_id", shuffle: bool = True) -> DataFrame:
    """doc (a struct of the columns of ``df``), copies, copy (from 1), rate and place: whole rows as often as drawn, where
    ``place`` is uniform in the global order that ``shuffle`` sorts the output by."""
    rate = rates(df, source, targets, other, size)
    g = group(df[source], targets)
    copies, mean = F.lit(0), F.lit(0.0)
    for name, r in sorted(rate.items()):
        parts = max(1, math.ceil(r / PART))
        cdf = F.array(*[F.lit(c) for c in poisson_cdf(r / parts)]).cast("array<double>")
        draws = [_invert(cdf, uniform(str(seed), str(k), df[key])) for k in range(parts)]
        copies = F.when(g == name, sum(draws[1:], draws[0])).otherwise(copies)
        mean = F.when(g == name, F.lit(r)).otherwise(mean)
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), copies.alias("copies"), mean.alias("rate")).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("place", uniform(f"{seed}place", F.col("doc")[key], F.col("copy")))
    return out.orderBy("place", F.col("doc")[key], "copy") if shuffle else out
