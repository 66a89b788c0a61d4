"""A store of features: one Parquet table a feature, described by JSON in a table beside them; logs and checkpoints.

Everything is written by Spark, so a store may lie wherever Spark can write."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    """Makes a dataclass known by its name, so that its JSON can be read again."""
    if not is_dataclass(cls):
        raise TypeError("only dataclasses are registered")
    REGISTRY[cls.__name__] = cls
    return cls


def to_json(obj) -> str:
    def plain(x):
        if is_dataclass(x):
            return {"type": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in fields(x)}}
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    return json.dumps(plain(obj), sort_keys=True)


def from_json(text: str):
    """The object of a JSON text; a type that is not registered is refused."""

    def built(x):
        if isinstance(x, dict):
            known = {k: built(v) for k, v in x.items() if k != "type"}
            if "type" not in x:
                return known
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}
            if x["type"] not in REGISTRY:
                raise KeyError(f"{x['type']!r} is not registered")
            return REGISTRY[x["type"]](**known)
        return [built(y) for y in x] if isinstance(x, list) else x

    return built(json.loads(text))


def run_id(config, length: int = 8) -> str:
    """The start of the hash of a configuration."""
    return hashlib.sha256((config if isinstance(config, str) else to_json(config)).encode()).hexdigest()[:length]


def described(df: DataFrame, column: str, **metadata) -> DataFrame:
    """``df`` with metadata on a column: ``elem`` (continuous or discrete), ``min``, ``max``, ``size``, ``sr``, ``unit``."""
    return df.withMetadata(column, {**df.schema[column].metadata, **metadata})


def bind(schema: StructType, column: str, elem: str) -> StructField:
    """The field of a feature; refused where it is missing or of another kind."""
    found = {f.name: f for f in schema.fields}
    if column not in found:
        raise KeyError(f"no feature {column!r}; there are {sorted(found)}")
    kind = found[column].metadata.get("elem", elem)
    if kind != elem:
        raise TypeError(f"{column} is {kind}, not {elem}")
    return found[column]


def one_rate(schema: StructType, columns: list[str]) -> int | None:
    """The sample rate that all columns share."""
    rates = {f.metadata["sr"] for f in schema.fields if f.name in columns and "sr" in f.metadata}
    if len(rates) > 1:
        raise ValueError(f"rates differ: {sorted(rates)}")
    return rates.pop() if rates else None


@register
@dataclass(frozen=True)
class Extractor:
    """A named feature and the names of the registered steps that make it from its parent."""

    name: str
    steps: tuple[str, ...] = ()
    derived_from: str | None = None
    merge_files_labels: bool = False
    consolidate_labels: bool = False


STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def step(name: str):
    """Registers a function from DataFrame to DataFrame as a step of pipelines."""

    def add(fn):
        STEPS[name] = fn
        return fn

    return add


def compose(*steps: str | Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps from left to right as one."""
    chain = [STEPS[s] if isinstance(s, str) else s for s in steps]

    def run(df: DataFrame) -> DataFrame:
        for fn in chain:
            df = df.transform(fn)
        return df

    return run


#: What must have come before a transform; ``any`` is any transform at all.
NEEDS = {"istft": ["stft"], "griffin_lim": ["mag_spec"], "mel_spec": ["mag_spec"], "mfcc": ["mag_spec", "mel_spec"], "chroma": ["mag_spec"], "harmonic": ["mag_spec"], "percussive": ["mag_spec"],
         "auto_convolve": ["mag_spec"], "f0_filter": ["mag_spec"], "neighbor_filter": ["any"], "pca": ["any"], "nmf": ["mag_spec"], "factor_analysis": ["any"]}


def can_add(chain: list[str], name: str) -> bool:
    """Whether a transform may follow a chain: its needs stand in it in their order."""
    at = 0
    for need in NEEDS.get(name, []):
        if need == "any":
            return bool(chain)
        if need not in chain[at:]:
            return False
        at = chain.index(need, at) + 1
    return True


def labelled(df: DataFrame, e: Extractor, source: str = "source_id", label: str = "label") -> DataFrame:
    """A label feature as its extractor asks: labels distinct between sources, dense, and with their number as metadata."""
    from ..operators.sequence import dense_codes
    from ..operators.windows import label_offsets

    if e.merge_files_labels:
        df = label_offsets(df, source, label, "_all").withColumn(label, F.col("_all")).drop("_all")
    if e.consolidate_labels:
        df = dense_codes(df, label, "_code").withColumn(label, F.col("_code")).drop("_code")
    if e.merge_files_labels or e.consolidate_labels:
        df = described(df, label, elem="discrete", class_size=int((df.agg(F.max(label)).first()[0] or 0) + 1))
    return df


class Selection:
    """A set of labels, and the rows that it keeps or leaves out."""

    def __init__(self, labels: tuple = ()):
        self.labels = set(labels)

    def add(self, *labels) -> Selection:
        self.labels |= set(labels)
        return self

    def remove(self, *labels) -> Selection:
        self.labels -= set(labels)
        return self

    def reset(self) -> Selection:
        self.labels.clear()
        return self

    def select(self, df: DataFrame, label: str) -> DataFrame:
        return df.where(F.col(label).isin(*self.labels)) if self.labels else df.limit(0)

    def unselect(self, df: DataFrame, label: str) -> DataFrame:
        return df.where(~F.coalesce(F.col(label).isin(*self.labels), F.lit(False))) if self.labels else df


def add_chunk(df: DataFrame, path: str, chunk: int) -> None:
    """Writes a chunk of a generation beside those before it; a chunk that is there already is replaced."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk={chunk}")


class FeatureStore:
    """Features in a folder. ``create`` writes the sources, ``compute`` a feature derived from another."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r"):
        if mode not in ("r", "r+", "w"):
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode

    def _write(self, name: str, df: DataFrame, extractor: Extractor) -> None:
        if self.mode == "r":
            raise PermissionError("the store is open for reading")
        df.write.mode("overwrite").parquet(f"{self.path}/features/{name}")
        meta = self.spark.createDataFrame([(name, to_json(extractor))], "name string, config string")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta/name={name}")

    def create(self, sources: DataFrame, extractors: list[Extractor]) -> FeatureStore:
        """One table an extractor, in the order given, so that one may derive from another."""
        for e in extractors:
            df = compose(*e.steps)(self.read(e.derived_from) if e.derived_from else sources)
            self._write(e.name, labelled(df, e), e)
        return self

    def compute(self, name: str, of: str, *steps: str | Callable) -> DataFrame:
        self._write(name, compose(*steps)(self.read(of)), Extractor(name, tuple(s if isinstance(s, str) else s.__name__ for s in steps), of))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/features/{name}")

    def _meta(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/meta")

    def schema(self) -> dict[str, Extractor]:
        found = (from_json(r["config"]) for r in self._meta().select("config").collect())
        return {e.name: e for e in found if e.name}

    def features(self, derived: bool = False) -> list[str]:
        return sorted(n for n, e in self.schema().items() if not derived or e.derived_from)

    def drop(self, name: str) -> None:
        """Removes a feature's table and what describes it, through the file system that holds the store."""
        if self.mode == "r":
            raise PermissionError("the store is open for reading")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in (f"{self.path}/features/{name}", f"{self.path}/meta/name={name}"):
            where = jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(conf).delete(where, True)


def log_metrics(spark: SparkSession, path: str, step_: int, metrics: dict[str, float]) -> None:
    """Appends (step, name, value) rows."""
    for n, v in metrics.items():
        if v != v:
            raise ValueError(f"nan in {n}")
    spark.createDataFrame([(step_, n, float(v)) for n, v in metrics.items()], "step long, name string, value double").coalesce(1).write.mode("append").parquet(path)


def epoch_means(metrics: DataFrame, epoch: str, name: str = "name", value: str = "value") -> DataFrame:
    """The mean of each metric in each epoch."""
    return metrics.groupBy(epoch, name).agg((F.sum(value) / F.count(value)).alias("mean"))


class CheckpointBank:
    """Weights and configurations by run and epoch: ``id=.../epoch=...`` folders, so a lookup reads one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, run: str, epoch: int) -> str:
        return f"{self.root}/id={run}/epoch={epoch}"

    def save(self, run: str, epoch: int, weights: dict[str, tuple[list[int], list[float]]], **configs) -> str:
        rows = [(n, list(shape), [float(v) for v in values], None) for n, (shape, values) in weights.items()] + [(f"config:{n}", None, None, to_json(c)) for n, c in configs.items()]
        self.spark.createDataFrame(rows, "name string, shape array<int>, `values` array<double>, config string").coalesce(1).write.mode("overwrite").parquet(self.path(run, epoch))
        return self.path(run, epoch)

    @staticmethod
    def parse(path: str) -> tuple[str, str, int]:
        """Root, run and epoch of a checkpoint's path."""
        root, run, epoch = path.rstrip("/").rsplit("/", 2)
        if not run.startswith("id=") or not epoch.startswith("epoch="):
            raise ValueError(f"{path} is no checkpoint")
        return root, run[3:], int(epoch[6:])

    def weights(self, run: str, epoch: int) -> dict[str, tuple[list[int], list[float]]]:
        d = self.spark.read.parquet(self.path(run, epoch)).where("config is null")
        return {r["name"]: (list(r["shape"]), list(r["values"])) for r in d.collect()}

    def config(self, run: str, epoch: int, name: str):
        return from_json(self.spark.read.parquet(self.path(run, epoch)).where(F.col("name") == f"config:{name}").first()["config"])

    def epochs(self, run: str) -> list[int]:
        """The epochs of a run, from the names of its folders."""
        d = self.spark.read.option("basePath", self.root).parquet(f"{self.root}/id={run}")
        return sorted(r["epoch"] for r in d.select("epoch").distinct().collect())

    def delete(self, run: str, epoch: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path(run, epoch))
        where.getFileSystem(conf).delete(where, True)


