"""A Spark data source of WAV files, and two pipelines that go from a signal to a model's inputs and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pointwise import linearize, mu_law_compress
from ..operators.blocks import Names
from ..operators.sampling import pairs
from ..operators.sequence import normalize
from ..operators.spectral import mag_spec


class WavSource(DataSource):
    """``spark.read.format("undaflow_wav").option("paths", "a.wav,b.wav")``: source_id, t, x, sr. Paths are such as every
    executor can open; ``wav.read`` goes through Spark's own readers and needs no such thing."""

    @classmethod
    def name(cls) -> str:
        return "undaflow_wav"

    def schema(self) -> str:
        return "source_id string, t long, x double, sr int"

    def reader(self, schema) -> DataSourceReader:
        return WavReader([p for p in self.options.get("paths", "").split(",") if p])


class WavReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from .wav import decode

        with open(partition.value, "rb") as f:
            rate, x = decode(f.read())
        for t, v in enumerate(x.tolist()):
            yield partition.value, t, v, rate


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def mulaw_io(df: DataFrame, source: Names, t: str, x: str, length: int, shift: int, hop: int = 1, levels: int = 256) -> DataFrame:
    """source, start, inputs (symbols as numbers in [-1, 1)) and targets (symbols) of the normalised, companded signal."""
    q = normalize(df, source, x, "_y").withColumn("q", mu_law_compress(F.col("_y"), levels))
    p = pairs(q, source, t, "q", length, shift, hop=hop)
    return p.withColumn("inputs", F.transform("inputs", lambda s: linearize(s, levels)))


def magspec_io(df: DataFrame, source: Names, t: str, x: str, n_fft: int, hop: int, length: int, shift: int = 1) -> DataFrame:
    """source, start, inputs and targets: runs of spectra and those ``shift`` frames later."""
    f = mag_spec(df, source, t, x, n_fft, hop, center=False)
    return pairs(f, source, "frame", "mag", length, shift)
