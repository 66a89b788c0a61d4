"""Streams over ``events``, drained, against the batch form of the same operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import work_dir
from ..streaming import stateful as T
from .signal_queries import _C, _r
from .window_queries import ORACLE as _WINDOWS


def _stream(spark, d):
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")
    return s.select("event_type", "event_id", (F.col("value") - 250).alias("x"), "user_id", F.col("ts").cast("timestamp").alias("ts"))


def _drained(spark, stream):
    at = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    return T.drain(stream, f"{at}/out", f"{at}/state")


def stream_remove_dc(spark, d):
    return _drained(spark, T.remove_dc(_stream(spark, d), "event_type", "event_id", "x")).select("event_id", F.round("y", 5).alias("y"))


def stream_entropy(spark, d):
    return _drained(spark, T.running_entropy(_stream(spark, d), "event_type", "event_id", "user_id")).select("event_id", _r("entropy").alias("entropy"))


def stream_means(spark, d):
    s = T.generate(_stream(spark, d), "event_type", "event_id", "x", lambda w: sum(w) / len(w), 4)
    return _drained(spark, s).select("event_id", _r("y").alias("y"))


QUERIES = {f.__name__: f for f in (stream_remove_dc, stream_entropy, stream_means)}
_T = "(SELECT event_type, event_id, user_id, x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS t FROM " + _C + ")"
ORACLE = {
    "stream_remove_dc": _WINDOWS["remove_dc"],
    "stream_entropy": f"""WITH c AS (SELECT s.event_id, s.t, e.user_id, count(*)::DOUBLE / (s.t + 1) AS p FROM {_T} s JOIN {_T} e ON e.event_type = s.event_type AND e.t <= s.t GROUP BY s.event_id, s.t, e.user_id)
SELECT event_id, round(-sum(p * ln(p)), 6) AS entropy FROM c GROUP BY event_id""",
    "stream_means": f"SELECT event_id, round(avg(x) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS y FROM {_T}",
}
