"""Work along sequences without a task that holds a whole sequence.

A sequence is numbered 0, 1, ... by ``indexed``; all else goes by blocks of that number. ``near`` gives every block
the rows within reach on both sides, ``running`` carries totals from block to block, ``reflected`` adds rows
beyond the ends. Null sources are sequences like others; joins on sources are null-safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

Names = list[str]
BLOCK = 1 << 16


def join_by(left: DataFrame, right: DataFrame, on: Names, how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls equal to nulls; the columns of ``left`` come first."""
    if not on:
        return left.crossJoin(F.broadcast(right.limit(1)))
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def indexed(df: DataFrame, source: Names, order: Names, out: str = "t") -> DataFrame:
    """The place 0, 1, ... of each row in its source. Rows are dealt by ranges of (source, order) and written, so
    that the numbers hold whatever is recomputed; a range starts where the counts of those before it end."""
    d = df.repartitionByRange(*source, *order) if source or order else df
    d = materialize(d.sortWithinPartitions(*source, *order).withColumn("_m", F.monotonically_increasing_id()), "index")
    d = d.withColumn("_p", F.shiftright("_m", 33))
    start = d.groupBy(*source, "_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_lo"))
    before = Window.partitionBy(*source).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = start.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return join_by(d, start, [*source, "_p"]).withColumn(out, F.col("_start") + F.col("_m") - F.col("_lo")).drop("_m", "_p", "_lo", "_start")


def lengths(df: DataFrame, source: Names, out: str = "n") -> DataFrame:
    return df.groupBy(*source).agg(F.count("*").alias(out))


def near(df: DataFrame, source: Names, t: str, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], block: int = BLOCK) -> DataFrame:
    """Columns over windows that reach ``before`` rows back and ``after`` ahead."""
    block = max(block, before, after, 1)
    home, at = F.floor(F.col(t) / block), F.pmod(F.col(t), F.lit(block))
    homes = F.array(home, *([F.when(at >= block - before, home + 1)] if before else []), *([F.when((at < after) & (home > 0), home - 1)] if after else []))
    d = df.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(homes)))
    w = Window.partitionBy(*source, "_block").orderBy(t)
    return d.withColumns({k: f(w) for k, f in columns.items()}).where("_home = _block").drop("_home", "_block")


def running(df: DataFrame, source: Names, t: str, x: Column, out: str, how: str = "sum", back: bool = False, block: int = BLOCK) -> DataFrame:
    """The sum, max or min of ``x`` from the start of the source to each row (``back``: from each row to the end)."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    d = df.withColumn("_x", x).withColumn("_block", F.floor(F.col(t) / block))
    order = lambda c: F.col(c).desc() if back else F.col(c).asc()
    inside = Window.partitionBy(*source, "_block").orderBy(order(t)).rowsBetween(Window.unboundedPreceding, 0)
    total = d.groupBy(*source, "_block").agg(agg("_x").alias("_total"))
    earlier = Window.partitionBy(*source).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_carry", agg("_total").over(earlier)).drop("_total")
    d = join_by(d.withColumn("_own", agg("_x").over(inside)), total, [*source, "_block"])
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[how]
    own = F.coalesce("_own", F.lit(0)) if how == "sum" else F.col("_own")
    return d.withColumn(out, both(own, F.col("_carry"))).drop("_x", "_block", "_total", "_carry", "_own")


def reflected(df: DataFrame, source: Names, t: str, x: str, left: int, right: int, odd: bool = False, edge: bool = False, n: str | None = None) -> DataFrame:
    """(source, t, x, n) with rows beyond both ends: mirrored through the end samples (``odd``: with their values
    mirrored too; ``edge``: the end samples themselves doubled). ``n`` is the source's length, taken from the column
    of that name if there is one. A row makes its own mirrored copies, so the signal is read once."""
    d = df.select(*source, t, x, F.col(n).alias("n")) if n else join_by(df.select(*source, t, x), lengths(df, source), source)
    e = 1 if edge else 0
    near_start, near_end = F.col(t).between(1 - e, left - e), F.col(t).between(F.col("n") - 1 - right + e, F.col("n") - 2 + e)
    low, high = F.col(x), F.col(x)
    if odd:
        ends = d.groupBy(*source).agg(F.max(F.when(F.col(t) == 0, F.col(x))).alias("_first"), F.max(F.when(F.col(t) == F.col("n") - 1, F.col(x))).alias("_last"))
        d = join_by(d, ends, source)
        low, high = 2 * F.col("_first") - F.col(x), 2 * F.col("_last") - F.col(x)
    one = lambda at, v: F.struct(at.cast("long").alias("t"), v.alias("x"))
    made = F.array(one(F.col(t), F.col(x)), F.when(near_start, one(-F.col(t) - e, low)), F.when(near_end, one(2 * (F.col("n") - 1) - F.col(t) + e, high)))
    d = d.select(*source, "n", F.explode(F.array_compact(made)).alias("_e"))
    return d.select(*source, F.col("_e.t").alias(t), F.col("_e.x").alias(x), "n")
