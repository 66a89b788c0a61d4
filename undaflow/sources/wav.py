"""Sound files as tables of samples, and back. Only 16-bit PCM in WAV is read; other codecs are not at hand."""

from __future__ import annotations

import io
import re
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOUND = r".*\.(wav|aif|aiff|mp3|mp4|m4a|webm)$"


def find(spark: SparkSession, folder: str, pattern: str = SOUND, recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of the files whose path matches; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime").where(F.lower("path").rlike(pattern) & ~F.col("path").rlike(r"/\.[^/]*$"))


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1)."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        return f.getframerate(), x.mean(axis=1) / 32768.0


def encode(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(np.asarray(x) * 32768.0), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read(spark: SparkSession, path: str | list[str], offset: float = 0.0, duration: float | None = None, chunk: int = 1 << 16) -> DataFrame:
    """(source_id, t, x, sr) of WAV files: ``duration`` seconds from ``offset`` on. Samples leave a file in chunks."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rate, x = decode(content)
                first = int(offset * rate)
                x = x[first : None if duration is None else first + int(duration * rate)]
                for a in range(0, len(x), chunk):
                    part = x[a : a + chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part), pa.array(np.full(len(part), rate, np.int32))], ["source_id", "t", "x", "sr"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInArrow(run, "source_id string, t long, x double, sr int")


def write(df: DataFrame, source: str, t: str, x: str, rate: int, folder: str, template: str = "{source}.wav") -> DataFrame:
    """Writes one file a source where Spark's writers can, as (path, content) rows in Parquet, and returns them. A template
    names files by ``{source}`` only."""
    if set(re.findall(r"{(\w+)}", template)) - {"source"}:
        raise ValueError("a template may use {source} only")

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by("t")
        name = template.replace("{source}", str(p.column("source")[0].as_py()))
        return pa.table({"path": [name], "content": pa.array([encode(np.asarray(p.column("x")), rate)], pa.binary())})

    d = df.select(F.col(source).cast("string").alias("source"), F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"))
    files = d.groupBy("source").applyInArrow(run, "path string, content binary")
    files.write.mode("overwrite").parquet(folder)
    return d.sparkSession.read.parquet(folder)
