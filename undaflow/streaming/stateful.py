"""Sequence operators on streams: the state of a source is what its next sample needs, and no more.

Rows of a source must come in order from batch to batch; inside a batch they are sorted. State lives in Spark's state store,
so a stream that stops goes on from its checkpoint. Each operator equals its batch form, whatever the batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold(stream: DataFrame, source: str, order: str, x: str, out: str, state: str, start: tuple, part: Callable[[tuple, pd.Series], tuple[object, tuple]]) -> DataFrame:
    """(source, order, out): ``part`` takes the state and a batch's samples in order to their values and the next state.
    ``state`` is the state's schema."""

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[[order, x]] for b in batches], ignore_index=True).sort_values(order)
        made, now = part(held.get if held.exists else start, rows[x])
        held.update(now)
        yield pd.DataFrame({source: [key[0]] * len(rows), order: rows[order].to_numpy(), out: made})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"`{source}` {kinds[source]}, `{order}` {kinds[order]}, `{out}` double"
    return stream.select(source, order, x).groupBy(source).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def scan(stream: DataFrame, source: str, order: str, x: str, out: str, state: str, start: tuple, step: Callable[[tuple, object], tuple[float, tuple]]) -> DataFrame:
    """``fold`` by a ``step`` that takes the state and one sample to a value and the next state."""

    def part(now, samples):
        made = []
        for v in samples.tolist():
            y, now = step(now, v)
            made.append(y)
        return made, now

    return fold(stream, source, order, x, out, state, start, part)


def remove_dc(stream: DataFrame, source: str, order: str, x: str, pole: float = 0.99, out: str = "y") -> DataFrame:
    """y = x - x before + pole * y before."""

    def step(now, v):
        y = v - now[0] + pole * now[1]
        return y, (v, y)

    return scan(stream, source, order, x, out, "x double, y double", (0.0, 0.0), step)


def deemphasis(stream: DataFrame, source: str, order: str, x: str, e: float, out: str = "y") -> DataFrame:
    """y = (1 - e) x + e * y before."""

    def step(now, v):
        y = (1 - e) * v + e * now[0]
        return y, (y,)

    return scan(stream, source, order, x, out, "y double", (0.0,), step)


def running_entropy(stream: DataFrame, source: str, order: str, symbol: str, out: str = "entropy") -> DataFrame:
    """Entropy (nats) of a source's symbols so far; null is a symbol like others. The state holds one count a symbol, and
    a batch looks each of them up once."""
    xlnx = lambda c: c * np.log(np.maximum(c, 1.0))

    def part(now, samples):
        n, total, symbols, counts = now
        code, found = pd.factorize(samples, use_na_sentinel=False)
        found = [None if pd.isna(s) else s for s in found]
        have = dict(zip(symbols, counts))
        before = np.array([have.get(s, 0) for s in found], dtype=np.float64)
        c = before[code] + pd.Series(code).groupby(code).cumcount().to_numpy() + 1
        # long sums in more digits than they come out with
        sums = (total + np.cumsum((xlnx(c) - xlnx(c - 1)).astype(np.longdouble))).astype(np.float64)
        at = n + np.arange(1, len(code) + 1)
        have.update(zip(found, (before + np.bincount(code)).astype(int).tolist()))
        return np.log(at) - sums / at, (int(at[-1]), float(sums[-1]), list(have), list(have.values()))

    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[symbol]
    # as text, a whole number next to a null stays exact; the zeros are one symbol
    d = stream.withColumn(symbol, (F.col(symbol) + F.lit(0) if kind in ("float", "double") else F.col(symbol)).cast("string"))
    return fold(d, source, order, symbol, out, "n long, total double, symbols array<string>, counts array<long>", (0, 0.0, [], []), part)


def generate(stream: DataFrame, source: str, order: str, x: str, fn: Callable[[list[float]], float], rf: int, out: str = "y") -> DataFrame:
    """What ``fn`` makes of the last ``rf`` samples (fewer at the start) at each sample."""

    def step(now, v):
        window = [*now[0], float(v)][-rf:]
        return float(fn(window)), (window,)

    return scan(stream, source, order, x, out, "window array<double>", ([],), step)


def tumbling_counts(stream: DataFrame, ts: str, key: str, size: str, late: str) -> DataFrame:
    """(start, key, n) of windows of event time, behind a watermark: an extension for streams with times of their own."""
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into Parquet, and reads it."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
