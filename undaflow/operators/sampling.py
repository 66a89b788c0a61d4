"""Batches: where they start, and the inputs and targets that are cut there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Names, join_by
from .windows import slices


def drawn(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def tbptt_starts(spark: SparkSession, n_samples: int, batch_size: int = 64, chunk_length: int = 8 * 16000, seq_len: int = 512, oversampling: int = 1, seed: int = 0) -> DataFrame:
    """(batch, step, track, start): tracks in a drawn order, ``batch_size`` at a time, each from a drawn offset below the remainder;
    a batch's tracks advance together by ``seq_len``. The last batch holds what is left."""
    chunk = min(chunk_length, n_samples)
    chunks = max(1, n_samples // chunk - int(oversampling > 1))
    remainder = max(n_samples % chunk, 1)
    d = spark.range(chunks * oversampling).withColumn("_u", drawn(seed, F.col("id")))
    d = shuffled(d, "_u", "id")
    d = d.withColumns({"batch": F.floor(F.col("place") / batch_size), "track": F.col("place") % batch_size})
    offset = F.floor(drawn(seed + 1, F.col("id")) * remainder)
    d = d.withColumn("_from", (F.col("id") % chunks) * chunk + offset).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(chunk // seq_len - 1))))
    return d.select("batch", "step", "track", (F.col("_from") + F.col("step") * seq_len).alias("start"))


def shuffled(df: DataFrame, by: str, key: str) -> DataFrame:
    """``df`` with ``place``, its number in the order of ``by``, then ``key``."""
    from .blocks import indexed

    return indexed(df, [], [by, key], "place")


def index_starts(spark: SparkSession, indices: list[int | None] | int, min_i: int = 0, max_i: int | None = None, stride: int = 1, seed: int = 0, turn: int = 0) -> DataFrame:
    """(k, start): given starts, and drawn ones (a multiple of ``stride``) where there is none; another ``turn`` draws anew."""
    given = [None] * indices if isinstance(indices, int) else list(indices)
    step = 1 if isinstance(indices, int) else stride
    if max_i is None and None in given:
        raise ValueError("drawn starts need max_i")
    d = spark.createDataFrame([(k, i) for k, i in enumerate(given)], "k long, given long")
    u = F.floor(drawn(seed, F.col("k"), F.lit(turn)) * ((max_i or 0) - min_i)) + min_i
    return d.select("k", F.coalesce("given", (F.floor(u / step) * step).cast("long")).alias("start"))


def pairs(df: DataFrame, source: Names, t: str, x: str, length: int, shift: int, target_length: int | None = None, hop: int = 1, stride: int = 1) -> DataFrame:
    """source, start, inputs, targets: windows and the windows ``shift`` later, for starts that have both whole."""
    a = slices(df, source, t, x, length, hop, 0, stride).withColumnRenamed("v", "inputs")
    b = slices(df, source, t, x, target_length or length, hop, shift, stride).withColumnRenamed("v", "targets")
    return join_by(a, b, [*source, "start"])


#: What a network reads and predicts: the target's shift and length from the input's length.
PAIRINGS = {
    "wavenet": lambda length, rf=1, **_: (rf, length - rf + 1), "samplernn": lambda length, frame=1, **_: (frame, length), "jukebox": lambda length, frame=1, **_: (frame, length),
    "transformer": lambda length, **_: (1, length), "seq2seq": lambda length, hop=1, **_: (hop, length),
}


def network_pairs(df: DataFrame, source: Names, t: str, x: str, kind: str, length: int, hop: int = 1, **parameters) -> DataFrame:
    shift, out = PAIRINGS[kind](length, **parameters)
    return pairs(df, source, t, x, length, shift, out, hop)


def at_starts(windows: DataFrame, starts: DataFrame, start: str = "start") -> DataFrame:
    """The windows of given starts, as often as each is given."""
    return starts.withColumnRenamed(start, "_s").join(windows, F.col("_s") == F.col(start)).drop("_s")


def jittered(starts: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """Starts moved ahead by a drawn number below ``most``."""
    return starts.withColumn("start", F.col("start") + F.floor(drawn(seed, F.col(key)) * max(most, 1)))


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, limit: int | None = None) -> DataFrame:
    """``df`` with ``batch``: rows in order (or, with a seed, in a drawn one) ``size`` at a time, the first ``limit`` batches."""
    u = F.col(key) if seed is None else drawn(seed, F.col(key))
    d = shuffled(df.withColumn("_u", u), "_u", key).withColumn("batch", F.floor(F.col("place") / size)).drop("_u", "place")
    return d if limit is None else d.where(F.col("batch") < limit)
