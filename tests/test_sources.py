"""Stores, sound files, checkpoints, configurations and streams: what is written is read again."""

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from undaflow.operators import blocks as B
from undaflow.operators import windows as W
from undaflow.session import clear, local_session, work_dir
from undaflow.sources import formats, store, wav
from undaflow.streaming import stateful


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 2, **{"spark.sql.codegen.wholeStage": "false"})


@pytest.fixture(scope="module")
def sound(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sound")
    x = {n: np.random.default_rng(k).uniform(-1, 1, 300) for k, n in enumerate("ab")}
    for n, v in x.items():
        (folder / f"{n}.wav").write_bytes(wav.encode(v, 100))
    (folder / "notes.txt").write_text("none")
    return folder, x


def test_sound_files(spark, sound):
    folder, x = sound
    assert wav.find(spark, str(folder)).count() == 2
    d = wav.read(spark, str(folder), offset=0.5, duration=1.0, chunk=17).withColumn("n", F.regexp_extract("source_id", r"(\w)\.wav$", 1))
    got = {}
    for r in d.collect():
        got.setdefault(r["n"], {})[r["t"]] = r["x"]
    for n, v in x.items():
        assert sorted(got[n]) == list(range(100)) and np.allclose([got[n][t] for t in range(100)], v[50:150], atol=1e-4)
    out = wav.write(d, "n", "t", "x", 100, f"{work_dir(spark)}/out", "take {source}.wav").collect()
    assert sorted(r["path"] for r in out) == ["take a.wav", "take b.wav"] and np.allclose(wav.decode(out[0]["content"])[1], [got[out[0]["path"][5]][t] for t in range(100)])
    with pytest.raises(ValueError):
        wav.write(d, "n", "t", "x", 100, f"{work_dir(spark)}/out", "{__import__}.wav")
    formats.register_sources(spark)
    assert spark.read.format("undaflow_wav").option("paths", f"{folder}/a.wav,{folder}/b.wav").load().count() == 600


@store.step("halved")
def halved(df):
    return df.withColumn("x", F.col("x") / 2)


def test_feature_store(spark, tmp_path):
    d = spark.createDataFrame([(s, k, float(k), k % 3 * 2) for s in ("p", "q") for k in range(9)], "source_id string, t long, x double, label long")
    made = store.FeatureStore(spark, f"file://{tmp_path}/db", "w").create(d, [
        store.Extractor("signal"), store.Extractor("half", ("halved",), "signal"), store.Extractor("labels", (), "signal", merge_files_labels=True, consolidate_labels=True)])
    made.compute("quarter", "half", "halved")
    again = store.FeatureStore(spark, f"file://{tmp_path}/db")
    assert again.features() == ["half", "labels", "quarter", "signal"] and again.features(derived=True) == ["half", "labels", "quarter"]
    assert again.read("quarter").agg(F.max("x")).first()[0] == 2.0 and again.schema()["quarter"] == store.Extractor("quarter", ("halved",), "half")
    labels = again.read("labels")
    assert {r["label"] for r in labels.collect()} == set(range(6)) and labels.schema["label"].metadata["class_size"] == 6
    with pytest.raises(PermissionError):
        again.drop("half")
    made.drop("half")
    assert again.features() == ["labels", "quarter", "signal"]
    store.add_chunk(d, f"file://{tmp_path}/chunks", 0)
    store.add_chunk(d.limit(3), f"file://{tmp_path}/chunks", 1)
    assert spark.read.parquet(f"file://{tmp_path}/chunks").where("chunk = 1").count() == 3
    pick = store.Selection((0,)).add(2, 4).remove(0)
    assert pick.select(d, "label").count() == 12 and pick.unselect(d, "label").count() == 6 and pick.reset().select(d, "label").count() == 0


def test_schemas_and_chains(spark):
    d = store.described(spark.range(3).withColumn("x", F.lit(1.0)), "x", elem="continuous", sr=16000)
    assert store.bind(d.schema, "x", "continuous").name == "x" and store.one_rate(d.schema, ["x"]) == 16000
    with pytest.raises(TypeError):
        store.bind(d.schema, "x", "discrete")
    with pytest.raises(KeyError):
        store.bind(d.schema, "y", "discrete")
    assert store.can_add(["mag_spec", "mel_spec"], "mfcc") and not store.can_add(["mag_spec"], "mfcc") and not store.can_add([], "pca") and store.can_add(["chroma"], "pca")
    with pytest.raises(ValueError):
        store.one_rate(store.described(d, "id", sr=8000).schema, ["id", "x"])


@store.register
@dataclass(frozen=True)
class Hyper:
    size: int = 3
    inner: object = None


def test_configurations_and_checkpoints(spark, tmp_path):
    h = Hyper(5, Hyper(1))
    assert store.from_json(store.to_json(h)) == h and len(store.run_id(h)) == 8 and store.run_id(h) != store.run_id(Hyper())
    with pytest.raises(KeyError):
        store.from_json('{"type": "os.system"}')
    bank = store.CheckpointBank(spark, f"file://{tmp_path}/bank")
    w = {"a": ([2, 2], [1.0, 2.0, 3.0, 4.0]), "b": ([1], [0.5])}
    path = bank.save("r1", 3, w, network=h)
    bank.save("r1", 7, w, network=h)
    assert bank.parse(path) == (f"file://{tmp_path}/bank", "r1", 3) and bank.weights("r1", 3) == w and bank.config("r1", 3, "network") == h and bank.epochs("r1") == [3, 7]
    bank.delete("r1", 3)
    assert bank.epochs("r1") == [7]
    log = f"file://{tmp_path}/log"
    for k in range(3):
        store.log_metrics(spark, log, k, {"loss": float(k)})
    assert store.epoch_means(spark.read.parquet(log).withColumn("epoch", F.lit(0)), "epoch").first()["mean"] == 1.0
    with pytest.raises(ValueError):
        store.log_metrics(spark, log, 3, {"loss": float("nan")})


def test_pipelines_to_inputs_and_targets(spark):
    x = np.sin(np.arange(64) / 3)
    d = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, t long, x double")
    p = formats.mulaw_io(d, ["s"], "t", "x", 8, 1, hop=8).orderBy("start").collect()
    assert len(p) == 7 and all(len(r["inputs"]) == len(r["targets"]) == 8 and 0 <= min(r["targets"]) and max(r["targets"]) < 256 for r in p)
    assert formats.magspec_io(d, ["s"], "t", "x", 16, 8, 3).count() == 7 - 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(s, k, float((k * 7 + len(s)) % 11 - 5)) for s in ("a", "bb") for k in range(40)]
    folder = f"file://{tmp_path}/in"
    for part in (rows[:25] + rows[40:60], rows[25:40] + rows[60:]):
        spark.createDataFrame(part, "s string, t long, x double").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("s string, t long, x double").parquet(folder)
        # the second run goes on from the first one's state
        got = stateful.drain(stateful.remove_dc(stream, "s", "t", "x"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    want = W.remove_dc(spark.createDataFrame(rows, "s string, t long, x double"), ["s"], "t", "x")
    a, b = ({(r["s"], r["t"]): r["y"] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_streamed_entropy_of_many_symbols(spark, tmp_path):
    """Symbols that come back in a later batch, nulls, and numbers beyond a double's digits."""
    from math import log

    rows = [(s, k, None if k % 7 == 0 else 2**60 + k * (k + len(s)) % 31) for s in ("a", "bb") for k in range(90)]
    folder = f"file://{tmp_path}/in"
    for part in (rows[:50] + rows[90:120], rows[50:90] + rows[120:]):
        spark.createDataFrame(part, "s string, t long, x long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("s string, t long, x long").parquet(folder)
        got = stateful.drain(stateful.running_entropy(stream, "s", "t", "x"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {(r["s"], r["t"]): r["entropy"] for r in got.collect()}
    assert len(got) == 180
    for s, t, _ in rows:
        seen = [x for a, b, x in rows if a == s and b <= t]
        assert abs(got[s, t] + sum(seen.count(x) / len(seen) * log(seen.count(x) / len(seen)) for x in set(seen))) < 1e-12


def test_intermediate_tables_are_removed(spark):
    d = B.indexed(spark.range(5), [], ["id"])
    assert d.count() == 5
    where = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(where)
    clear(spark)
    assert not files.exists(where)
