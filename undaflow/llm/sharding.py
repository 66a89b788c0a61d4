"""Operator 8: hierarchical weighted hash tree, in DataFrame functions only.

A shard's draw for a key is ``-ln(u) / weight`` with u a hash of key and shard; the draw of a rack or region is the
least of those below it, which is distributed as one draw at the node's whole weight. A key descends
from region to rack to shard, each time to the child of the least draw. A draw depends on its shard's weight alone,
so a change of weights moves keys only into or out of the shards whose weights change, and one more shard takes
rows only into itself, at every count: law ``key``.

Slots need no task that holds a shard: rows are ranked in hash blocks, and a block starts where the counts of
those before it end.

Cases: null text has no bytes and checksum 0; a null key hashes as the empty string; rows of one key share
a shard and get different slots; an empty table gives an empty table; columns beside key and text are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .mixing import uniform


def tree(shards: int, racks: int = 3, per_rack: int = 4) -> dict[int, dict[int, list[int]]]:
    out: dict = {}
    for s in range(shards):
        out.setdefault(s // (racks * per_rack), {}).setdefault(s // per_rack, []).append(s)
    return out


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """(draw, shard) of one shard for a key."""
    return F.struct((-F.log(uniform("shard", str(shard), key) + F.lit(2.0**-53)) / F.lit(float(weight))).alias("s"), F.lit(shard).alias("c"))


def _least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def descend(draws: dict[int, Column], nodes: dict[int, dict[int, list[int]]]) -> Column:
    """The shard that a key's draws lead to; shards without a draw (of weight 0) take nothing."""
    regions = []
    for racks in nodes.values():
        rack = [_least([draws[s] for s in ss if s in draws]) for ss in racks.values() if any(s in draws for s in ss)]
        if rack:
            regions.append(_least(rack))
    return _least(regions)["c"]


def shard_of(key: Column, shards: int, weights: dict[int, float] | None = None) -> Column:
    """The shard of a key; weights default to 1."""
    w = {s: (weights or {}).get(s, 1.0) for s in range(shards)}
    return descend({s: draw(key, s, x) for s, x in w.items() if x > 0}, tree(shards))


def shard(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", per_block: int = 500) -> DataFrame:
    """Per row key, size, checksum, law, ``shard``, ``slot`` (gapless in the shard) and ``grown_shard``; blocks hold about ``per_block`` rows."""
    k = df[key]
    raw = F.encode(F.coalesce(df[text], F.lit("")), "UTF-8")
    rows = materialize(df.select(
        k.cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.array(*[draw(k, s) for s in range(shards + 1)]).alias("_d"),
    ).select("doc_id", "size", "text_crc32", descend({s: F.get("_d", F.lit(s)) for s in range(shards)}, tree(shards)).alias("shard"),
             descend({s: F.get("_d", F.lit(s)) for s in range(shards + 1)}, tree(shards + 1)).alias("grown_shard")), "shard")
    blocks = max(1, -(-rows.count() // (shards * per_block)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("block")), F.lit(blocks)).cast("int"))
    starts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")))
    out = ranked.join(starts.select("shard", "block", "start"), ["shard", "block"])
    return out.select(F.col("doc_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard")
