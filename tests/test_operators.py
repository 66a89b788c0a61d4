"""Properties that hold whatever the partitions: numbering, windows, nulls, ends, round trips and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undaflow.functions import layers as N
from undaflow.functions import losses as L
from undaflow.functions import matrices as M
from undaflow.functions import units as U
from undaflow.operators import blocks as B
from undaflow.operators import cluster as C
from undaflow.operators import decompose as D
from undaflow.operators import generate as G
from undaflow.operators import neighbors as K
from undaflow.operators import sampling as A
from undaflow.operators import segment as S
from undaflow.operators import sequence as Q
from undaflow.operators import spectral as X
from undaflow.operators import windows as W
from undaflow.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(4, 2, **{"spark.sql.codegen.wholeStage": "false"})


@pytest.fixture(scope="module")
def values():
    """Three sources: one without a name, one of a single sample, with nulls and ties."""
    r = random.Random(3)
    x = {"a": [float(r.randint(-5, 5)) for _ in range(97)], None: [float(r.randint(-5, 5)) for _ in range(23)], "one": [2.0]}
    x["a"][10] = x[None][5] = None
    return x


def table(spark, values, parts=3):
    rows = [(s, 1000 + k, v) for s, xs in values.items() for k, v in enumerate(xs)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "s string, o long, x double").repartition(parts)


def by_source(df, t="t", c="y"):
    out = {}
    for r in df.collect():
        out.setdefault(r["s"], {})[r[t]] = r[c]
    return {s: [d[k] for k in sorted(d)] for s, d in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_and_windows_over_partitions(spark, values, parts):
    d = B.indexed(table(spark, values, parts).repartition(parts), ["s"], ["o"])
    assert by_source(d, c="x") == values
    diff = {s: [None if k == 0 or x[k] is None or x[k - 1] is None else x[k] - x[k - 1] for k in range(len(x))] for s, x in values.items()}
    low = {s: [min(v for v in x[max(0, k - 3) : k + 2] if v is not None) for k in range(len(x))] for s, x in values.items()}
    total = {s: [sum(v or 0 for v in x[: k + 1]) for k in range(len(x))] for s, x in values.items()}
    for block in (1, 5, 64):
        assert by_source(B.near(d, ["s"], "t", 1, 0, {"y": lambda w: F.col("x") - F.lag("x").over(w)}, block)) == diff
        assert by_source(B.near(d, ["s"], "t", 3, 1, {"y": lambda w: F.min("x").over(w.rowsBetween(-3, 1))}, block)) == low
        assert by_source(B.running(d, ["s"], "t", F.col("x"), "y", block=block)) == total
        last = by_source(B.running(d, ["s"], "t", F.when(F.col("x") > 4, F.col("t")), "y", "max", block=block))
        ahead = by_source(B.running(d, ["s"], "t", F.when(F.col("x") > 4, F.col("t")), "y", "min", back=True, block=block))
        for s, x in values.items():
            at = [k for k, v in enumerate(x) if v is not None and v > 4]
            assert last[s] == [max([k for k in at if k <= t], default=None) for t in range(len(x))]
            assert ahead[s] == [min([k for k in at if k >= t], default=None) for t in range(len(x))]


def test_operators_keep_rows_of_null_sources(spark, values):
    d = B.indexed(table(spark, values), ["s"], ["o"])
    n = sum(map(len, values.values()))
    assert Q.normalize(d, ["s"], "x").count() == n
    assert W.label_offsets(d.withColumn("l", F.col("x").cast("long")), "s", "l").count() == n
    assert W.remove_dc(d.fillna(0.0, ["x"]), ["s"], "t", "x").count() == n
    assert W.moving_min(d, ["s"], "t", "x", 2, 2).count() == n
    coded = Q.dense_codes(d, "x", "y").select("x", "y").distinct().collect()
    assert sorted(r["y"] for r in coded) == list(range(len(coded))) and len(coded) == len({v for x in values.values() for v in x})
    w = W.slices(d, ["s"], "t", "x", 4, 2).where("s = 'a'").collect()
    assert {r["start"]: r["v"] for r in w} == {k: values["a"][k : k + 4] for k in range(0, 94, 2)}
    empty = d.limit(0)
    assert all(f.count() == 0 for f in (Q.normalize(empty, ["s"], "x"), Q.runs(empty, ["s"], "t", "x"), W.slices(empty, ["s"], "t", "x", 4), B.indexed(empty.drop("t"), ["s"], ["o"])))


def test_normalize_leaves_zeros_and_local_max_sees_the_last_sample(spark):
    d = spark.createDataFrame([("z", k, 0.0) for k in range(4)] + [("r", k, float(k)) for k in range(4)], "s string, t long, x double")
    assert by_source(Q.normalize(d, ["s"], "x")) == {"z": [0.0] * 4, "r": [0.0, 1 / 3, 2 / 3, 1.0]}
    assert by_source(Q.local_max(d, ["s"], "t", "x"), c="peak") == {"z": [False] * 4, "r": [False, False, False, True]}


def test_periods_snap_and_ranks(spark):
    x = [-1.0, 1.0, 2.0, -1.0, -2.0, 3.0, 1.0, -1.0, 2.0, 2.0]
    d = spark.createDataFrame([("s", k, v) for k, v in enumerate(x)], "s string, t long, x double")
    assert {(r["attack"], r["peak"]) for r in Q.periods(d, ["s"], "t", "x").collect()} == {(1, 2), (5, 6), (8, 9)}
    q = W.quantile(d, ["s"], "x", {"a": 0.0, "b": 0.3, "c": 1.0}).first()
    assert (q["a"], q["c"]) == (-2.0, 3.0) and q["b"] == pytest.approx(np.quantile(x, 0.3))
    assert {r["t"]: r["rank"] for r in W.ranks(d, ["s"], "x", "t").collect()} == {t: k for k, t in enumerate(sorted(range(10), key=lambda k: (x[k], k)))}


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("alignment", ["end", "start"])
def test_spectra_and_back(spark, center, alignment):
    r = np.random.default_rng(1)
    x = r.normal(size=16 * 7 + 5)
    d = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, t long, x double")
    s = X.stft(d, ["s"], "t", "x", 32, 16, center=center, alignment=alignment)
    unit = U.Frame(32, 16, center)
    frames = U.convert(len(x), U.Sample(), unit, True) + int(center)
    assert s.count() == frames
    y = by_source(X.istft(s, ["s"], 32, 16, center=center), c="x")["s"]
    size = U.convert(frames, unit, U.Sample(), True)
    want = x[len(x) - size :] if alignment == "end" else x[:size]
    assert len(y) == size
    # the window is 0 at the first sample of an unpadded frame
    assert np.allclose(y[1:] if not center else y, want[1:] if not center else want)
    if center:
        again = by_source(X.griffin_lim(X.mag_spec(d, ["s"], "t", "x", 32, 16, alignment=alignment), ["s"], 32, 16, 4), c="x")["s"]
        assert len(again) == size and not np.allclose(again, want)


def test_levels_by_blocks(spark):
    x = np.abs(np.random.default_rng(9).normal(size=900))
    d = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, t long, x double").repartition(5)
    level, want = 0.0, []
    for v in x:
        level += (0.75 if v > level else 0.3) * (v - level)
        want.append(level)
    for block in (150, 1 << 16):
        got = by_source(X.attack_release(d, ["s"], "t", "x", 0.75, 0.3, block=block), c="level")["s"]
        assert len(got) == 900 and np.allclose(got, want, rtol=0, atol=1e-13)


def test_filters_and_transforms():
    mel = M.mel_filters(16000, 512, 40)
    assert mel.shape == (40, 257) and (mel >= 0).all() and (mel.sum(axis=1) > 0).all()
    assert np.allclose(M.mel_to_hz(M.hz_to_mel([50.0, 999.0, 4000.0])), [50, 999, 4000]) and np.allclose(M.mel_to_hz(M.hz_to_mel([50.0, 4000.0], True), True), [50, 4000])
    assert np.allclose(M.dct(8, 8) @ M.dct(8, 8).T, np.eye(8))
    c = M.chroma_filters(22050, 4096)
    assert c.shape == (12, 2049) and c[:, round(440 * 4096 / 22050)].argmax() == 9
    assert M.checker(2).shape == (5, 5) and abs(M.checker(2)).sum() == pytest.approx(1)
    h = M.harmonic_sum(9, 4, 4)
    s = np.zeros(9)
    s[[2, 4, 6]] = 1
    assert (h @ s)[2] == pytest.approx(3) and M.positions(4, 6)[0].tolist() == [0, 1, 0, 1, 0, 1]


def test_units():
    s, f, sec = U.Sample(16000), U.Frame(2048, 512), U.Second(16000)
    assert U.convert(2048, s, f, True) == 1 and U.convert(1, f, s, True) == 2048 and U.convert(3, U.Frame(8, 4, True), s) == 8
    assert U.convert(8000, s, sec) == 0.5 and U.convert(0.5, sec, s) == 8000 and U.convert(0.5, sec, f, True) == 12
    assert U.convert(2.5, sec, U.Second()) == 2.5 and U.convert(7, U.Step(), s) == 7
    for a, b in ((sec, U.Step()), (U.Step(), sec)):
        with pytest.raises(TypeError):
            U.convert(1, a, b)
    with pytest.raises(ValueError):
        U.convert(1, U.Sample(8000), sec)
    both = U.ItemSpec(0, 1, 1, f) + U.ItemSpec(1.0, 0.5, 2, sec)
    assert both == U.ItemSpec(16000, 2048 + 8000, 2, s) or both.length > 0
    with pytest.raises(ValueError):
        U.ItemSpec(unit=f) + U.ItemSpec(unit=U.Frame(8, 4))
    assert U.n_steps(1.0, 16000, s) == 16000 and U.n_steps(1.0, 16000, f) == (16000 - 1536) // 512 + 1 and U.elapsed(90061.5) == (1, 1, 1, 1.5)


def points(spark, x):
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "k long, v array<double>").repartition(3)


def test_neighbours_and_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 4))
    x[7] = x[3]
    d = points(spark, x)
    for metric in K.METRICS:
        full = K.distances(x, x, metric)
        for blocks in (7, 100):
            got = {}
            for e in K.knn(d, d, "k", "v", 5, metric, per_block=blocks, per_part=13).collect():
                got.setdefault(e["src"], []).append((e["rank"], e["dst"]))
            for k in range(60):
                want = sorted((round(full[k, j], 12), j) for j in range(60) if j != k)[:5]
                assert [j for _, j in sorted(got[k])] == [j for _, j in want]
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 4), (9, 9)], "src long, dst long")
    found = {e["k"]: e["component"] for e in C.connected_components(d, edges, "k").collect()}
    assert [found[k] for k in (0, 1, 2, 4, 5, 9)] == [0, 0, 0, 4, 4, 9] and len(found) == 60
    assert C.connected_components(d, edges.limit(0), "k").where("k <> component").count() == 0
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert C.connected_components(d, chain, "k").where("k <= 40 and component <> 0").count() == 0


def test_nearest_rows_without_all_differences(monkeypatch):
    """The matrix product finds the same rows and distances, also far from zero, and makes no matrix of differences."""
    r = np.random.default_rng(6)
    for shift in (0.0, 1e6):
        x, y = r.normal(size=(30, 6)) + shift, r.normal(size=(700, 6)) + shift
        y[:30] = x
        full = K.distances(x, y, "euclidean")
        with monkeypatch.context() as m:
            m.setattr(K, "distances", None)
            for k in (1, 8, 900):
                i, j, d = K.nearest(x, y, k, (np.arange(30), np.arange(30)))
                want = full.copy()
                want[np.arange(30), np.arange(30)] = np.inf
                want = (want <= np.sort(want, axis=1)[:, min(k, 699) - 1][:, None] + 1e-12) & np.isfinite(want)
                assert [i.tolist(), j.tolist()] == [c.tolist() for c in np.nonzero(want)] and (d == full[i, j]).all()
            assert np.allclose(K.euclidean(x, y), full, rtol=1e-9, atol=0)
    assert (K.nearest(x * 1e200, y, 1)[2].size, K.nearest(np.array([[np.nan]]), np.array([[1.0]]), 1)[2].size) == (0, 0)


def test_single_linkage_keeps_no_table_of_pairs(spark, monkeypatch):
    r = np.random.default_rng(12)
    x = np.concatenate([r.normal(c, 0.3, size=(20, 3)) for c in ([0, 0, 5], [5, 0, 0], [0, 5, 0])])
    x[17] = x[40] = x[3]
    rows, write = [], C.materialize

    def noted(df, name="t"):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(C, "materialize", noted)
    full, group = K.distances(x, x, "euclidean"), list(range(60))
    for _, i, j in sorted((full[i, j], i, j) for j in range(60) for i in range(j)):
        if len(set(group)) > 5 and group[i] != group[j]:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    got = {e["k"]: e["label"] for e in C.single_linkage(points(spark, x), "k", "v", 5, known=2).collect()}
    assert [got[i] for i in range(60)] == [sorted(set(group)).index(g) for g in group]
    assert max(rows) < 60 * 59 / 4


def test_clusterings(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.05, size=(12, 3)) for c in ([0, 0, 5], [5, 0, 0], [0, 5, 0])])
    d = points(spark, x)
    truth = np.repeat([0, 1, 2], 12)
    for name, more in (("kmeans", {"k": 3}), ("qcores", {"n_neighbors": 4, "core_neighbors": 3}), ("agglo_single", {"k": 3}), ("gcluster", {"n_means": 3, "n_iter": 30, "seed": 5})):
        got = {e["k"]: e["label"] for e in C.cluster(d, "k", "v", name, **more).collect()}
        assert len(got) == 36
        if name == "gcluster":
            assert len(set(got.values())) > 1
        elif name in ("kmeans", "agglo_single"):
            assert [got[k] for k in range(36)] == truth.tolist(), name
        else:
            assert all(len({truth[k] for k in got if got[k] == c}) == 1 for c in set(got.values())), name
    levels = {}
    for e in C.hcluster(d, "k", "v", metric="euclidean").collect():
        levels.setdefault(e["level"], {})[e["k"]] = e["label"]
    for a, b in zip(sorted(levels)[:-1], sorted(levels)[1:]):
        assert all(levels[b][i] == levels[b][j] for i in range(36) for j in range(36) if levels[a][i] == levels[a][j])
    assert len(set(levels[max(levels)].values())) == 1
    with pytest.raises(KeyError):
        C.cluster(d, "k", "v", "none")


def plain_tree(x, k, ward):
    """One merge at a time, by the definitions."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def far(a, b):
            if ward:
                return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(axis=0) - x[b].mean(axis=0))
            return max(np.linalg.norm(x[i] - x[j]) for i in a for j in b)

        i, j = min(((i, j) for j in range(len(groups)) for i in range(j)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("name", ["agglo_complete", "agglo_ward"])
def test_linkages(spark, name):
    x = np.random.default_rng(8).normal(size=(18, 2))
    for k in (1, 4):
        got = {}
        for e in C.cluster(points(spark, x), "k", "v", name, k=k).collect():
            got.setdefault(e["label"], []).append(e["k"])
        assert sorted(sorted(g) for g in got.values()) == plain_tree(x, k, name == "agglo_ward")


def test_decompositions(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(80, 3)) @ r.normal(size=(3, 6)) + 0.01 * r.normal(size=(80, 6))
    d = points(spark, x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, sv, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([e["scores"] for e in sorted(D.pca(d, "v", 3).collect(), key=lambda e: e["k"])])
    axes = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3]).argmax(axis=1), range(3)])
    assert np.allclose(got, z @ axes)
    p = np.abs(x)
    w = np.array([e["weights"] for e in sorted(D.nmf(points(spark, p), "v", 6, max_iter=40).collect(), key=lambda e: e["k"])])
    h = np.linalg.lstsq(w, p, rcond=None)[0]
    assert (w >= 0).all() and np.linalg.norm(p - w @ h) < 0.2 * np.linalg.norm(p)
    f = np.array([e["factors"] for e in sorted(D.factor_analysis(d, "v", 3, max_iter=200).collect(), key=lambda e: e["k"])])
    fit = np.linalg.lstsq(f, x - x.mean(axis=0), rcond=None)[0]
    assert np.linalg.norm(x - x.mean(axis=0) - f @ fit) < 0.05 * np.linalg.norm(x)


def plain_peaks(x, before, after, least):
    """Accepted by height, as the rule says."""
    size, n = before + after, len(x)
    low = [x.min() if k - size // 2 < 0 or k + size - size // 2 - 1 >= n else x[k - size // 2 : k + size - size // 2].min() for k in range(n)]
    peak = [k for k in range(n) if (k == 0 or x[k] > x[k - 1]) and k > 0 and (k == n - 1 or x[k] >= x[k + 1]) and (x[k] - low[k]) / (x.max() - x.min()) >= least]
    taken = []
    for m in sorted(peak, key=lambda k: -x[k]):
        i, j = max(0, m - before), min(n, m + after)
        if not any(i <= t < j for t in taken) and m > i and x[m] > x[i:m].mean() and x[m] > x[m:j].mean():
            taken.append(m)
    return sorted(taken)


def test_novelty_and_peaks(spark):
    r = np.random.default_rng(5)
    f = np.concatenate([np.tile(r.normal(size=8), (20, 1)) for _ in range(3)]) + 0.01 * r.normal(size=(60, 8))
    d = spark.createDataFrame([("s", k, [float(a) for a in v]) for k, v in enumerate(f)], "s string, t long, v array<double>")
    found, picked, curve = S.cuts(d, ["s"], "t", "v", [4], 4, 0.1)
    assert sorted(e["t"] for e in found.collect()) == [19, 40] or {abs(e["t"] - c) <= 1 for e in found.collect() for c in (20, 40) if abs(e["t"] - c) < 5} == {True}
    assert picked.count() > 0 and curve.count() == 60
    x = r.normal(size=200).round(3)
    e = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, t long, x double")
    assert sorted(q["t"] for q in S.global_peaks(e, ["s"], "t", "x", 4, 5, 0.1).collect()) == plain_peaks(x, 4, 5, 0.1)
    cand = [k for k in range(200) if x[k] == x[max(0, k - 3) : k + 3].max() and x[k] >= x[max(0, k - 3) : k + 3].mean() + 0.1]
    want, last = [], -99
    for k in cand:
        if k - last > 4:
            want.append(k)
            last = k
    assert sorted(q["t"] for q in S.peak_pick(e, ["s"], "t", "x", 3, 3, 3, 3, 0.1, 4).collect()) == want


def test_samples_of_a_signal(spark):
    t = np.arange(4000)
    x = np.sin(t / 5) * np.where((t % 1000) < 500, np.exp(-(t % 1000) / 100), 0.001)
    d = spark.createDataFrame([("s", int(k), float(v)) for k, v in zip(t, x)], "s string, t long, x double")
    found = S.sample_cuts(d, ["s"], "t", "x", sensitivity=0.1, levels=[(256, 8, 5), (64, 8, 3)])
    at = sorted(e["cut"] for e in found.collect())
    assert len(at) >= 3 and all(min(abs(a - c) for c in range(0, 4001, 1000)) < 200 for a in at)
    assert S.sample_labels(d, ["s"], "t", found).agg(F.max("label")).first()[0] == len(set(at))


def test_batches(spark):
    got = A.tbptt_starts(spark, 1000, 3, 100, 20, 1, seed=2).collect()
    assert len(got) == 10 * 5 and {e["batch"] for e in got} == {0, 1, 2, 3} and all(0 <= e["start"] <= 980 for e in got)
    by = {}
    for e in got:
        by.setdefault((e["batch"], e["track"]), []).append((e["step"], e["start"]))
    assert all(b - a == 20 for v in by.values() for a, b in zip([s for _, s in sorted(v)], [s for _, s in sorted(v)][1:]))
    again = A.tbptt_starts(spark, 1000, 3, 100, 20, 1, seed=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    i = A.index_starts(spark, [4, None, 6], 8, 80, 8).orderBy("k").collect()
    assert [e["start"] for e in i][::2] == [4, 6] and i[1]["start"] % 8 == 0 and 8 <= i[1]["start"] < 80
    assert sorted(e["batch"] for e in A.batches(spark.range(7), "id", 3, seed=1).collect()) == [0, 0, 0, 1, 1, 1, 2]


def test_generation(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 4.0])], "s string, v array<double>")
    got = {e["s"]: e["v"] for e in G.generate(d, ["s"], "v", G.Stateless(2, lambda w: w.sum()), 3).collect()}
    assert got == {"a": [1, 2, 3, 5, 8, 13], None: [0, 0, 4, 4, 8, 12]}
    assert G.chunked(d, ["s"], "v", G.Stateless(2, lambda w: w.sum()), 2, 3, 2).where("s = 'a' and chunk = 1").first()["v"] == [21, 34, 55]
    assert G.encode_decode(d, ["s"], "v", lambda w: w[::-1], 2).where("s = 'a'").first()["v"] == [2, 1, 3]
    with pytest.raises(ValueError):
        G.extend(np.ones(1), G.Stateless(2, np.sum), 1)
    plan = G.ensemble_plan([("x", 4.0, 1.0), ("y", 4.0, 1.0), ("z", 4.0, 1.0)], 10, 10.0)
    assert plan == [("x", 0, 40, 1.0), ("y", 40, 40, 1.0), ("silence", 80, 20, 1.0)]
    out = G.ensemble(np.ones(4), [("x", 0.5, 1.0), ("y", 0.7, 1.0)], {"x": G.Stateless(1, lambda w: w[-1:] + 1), "y": G.Stateless(1, lambda w: -w[-1:])}, 10, 1.0)
    assert len(out) == 10 and out[4] == 6 and out[5:].tolist() == [0.0] * 5
    walk = G.temperature_walk(50, step=0.2)
    assert len(walk) == 50 and min(walk) >= 0.85 and max(walk) <= 0.999
    a = np.arange(12.0).reshape(6, 2) + 1
    path = K.dtw(K.distances(a[2:5], a, "euclidean"))
    assert path == [(0, 2), (1, 3), (2, 4)]


def test_fast_generation_equals_the_plain_one():
    r = np.random.default_rng(6)
    dil = G.dilations([3, 3])
    assert dil == [1, 2, 4, 1, 2, 4] and G.receptive_field([2] * 6, dil) == 15
    layers = [(r.normal(size=(2, 1 if False else 3, 4)), r.normal(size=(2, 3, 4)), r.normal(size=(4, 5)), 0.1 * r.normal(size=(4, 3))) for _ in dil]
    layers[0] = (r.normal(size=(2, 1, 4)), r.normal(size=(2, 1, 4)), r.normal(size=(4, 5)), 0.1 * r.normal(size=(4, 1)))
    layers = [layers[0]] + [(r.normal(size=(2, 1, 4)), r.normal(size=(2, 1, 4)), r.normal(size=(4, 5)), 0.1 * r.normal(size=(4, 1))) for _ in dil[1:]]
    stack = G.GatedStack(layers, dil, 0.1 * r.normal(size=(5, 1)))
    prompt = r.normal(size=20)
    assert stack.rf == 15 and stack.forward(prompt[:15, None]).shape == (1, 1)
    with pytest.raises(ValueError):
        stack.forward(prompt[:14, None])
    assert np.allclose(G.extend(prompt, stack, 9), G.extend(prompt, N.FastStack(stack), 9))


def test_layers():
    r = np.random.default_rng(7)
    x, ids = r.normal(size=(2, 12, 3)), r.integers(0, 5, (2, 12))
    table = r.normal(size=(5, 4))
    assert N.embedding_bag(ids, 4, 4, table).shape == (2, 3, 4) and np.allclose(N.embedding_bag(ids, 1, 1, table), N.embedding(ids, table))
    assert N.framed_linear(x[..., 0], 4, 2, r.normal(size=(4, 6))).shape == (2, 5, 6)
    w = r.normal(size=(3, 3, 8))
    z, y = N.tied_autoencoder(x, [w], [3])
    assert z.shape == (2, 4, 8) and y.shape == x.shape
    # the transpose: <conv x, z> = <x, conv^T z>
    assert (N.conv1d(x, w, 3) * z).sum() == pytest.approx((x * N.conv_transpose1d(z, w, 3)).sum())
    lw = (r.normal(size=(3, 16)), r.normal(size=(4, 16)), r.normal(size=16))
    whole, end = N.lstm(x, *lw)
    half, state = N.lstm(x[:, :6], *lw)
    assert np.allclose(whole[:, 6:], N.lstm(x[:, 6:], *lw, state=state)[0]) and np.allclose(end[0], whole[:, -1])
    assert N.encode(x, lw, "edge_mean")[0].shape == (2, 1, 4) and N.decode(x[:, :1], 5, lw).shape == (2, 5, 4)
    q = [r.normal(size=(3, 6)) for _ in range(3)]
    seen = N.attention(x, *q, heads=2)
    changed = x.copy()
    changed[:, 6:] += 1
    assert np.allclose(seen[:, :6], N.attention(changed, *q, heads=2)[:, :6])
    assert N.transformer_layer(x, *q, r.normal(size=(6, 3)), r.normal(size=(3, 7)), r.normal(size=(7, 3)), 2).shape == x.shape
    assert N.tier(x[..., 0], 3, lw, r.normal(size=(3, 4, 2)))[0].shape == (2, 12, 2)
    assert N.mlp(x, [(r.normal(size=(3, 5)), 0.0)], min_temperature=0.5).shape == (2, 12, 4)
    assert N.phase_shuffle(x, np.array([2, -2])).shape == x.shape and N.cosine_anneal(0, 10, 1.0, 0.0) == 1 and N.cosine_anneal(10, 10, 1.0, 0.0) == pytest.approx(0)
    assert N.due(4, 2) and not N.due(3, [1, 2]) and N.reset_due(3, None) and not N.reset_due(3, 2)
    assert np.allclose(N.logistic(0.0, 0.0, np.array([0.5])), 0) and N.resampled(x, 2, 1, r.normal(size=(3, 6))).shape == (2, 24, 3)
    s = N.Switch(lambda v: "train", lambda v: "generate")
    s.training = False
    assert s(1) == "generate" and N.norm_of([np.array([3.0]), np.array([4.0])]) == 5
    with pytest.raises(ValueError):
        N.checked(np.array([np.nan]))
    assert L.independence([[1.0, 0.0], [0.0, 1.0]]) == 0
    with pytest.raises(TypeError):
        L.objective("categorical_dist", "continuous")


def test_drawn_scales_stay_in_bounds(spark):
    d = spark.range(500).select(F.col("id").alias("t"), F.lit(1.0).alias("o"), F.lit(1.0).alias("y"))
    loss = L.scaled_l1(d, "t", F.col("t"), "o", "y").first()["loss"]
    assert 0 < loss < 0.06 and math.isclose(loss, L.scaled_l1(d, "t", F.col("t"), "o", "y").first()["loss"])


def test_distances_over_time_by_blocks(spark):
    """Every pair of a batch element's steps: over several blocks, at one time, near copies, and without what is null."""
    from undaflow.functions import losses as L

    r = np.random.default_rng(4)
    rows = [(b, k // 2, r.normal(size=3).tolist(), r.normal(size=3).tolist()) for b in ("a", "b", None) for k in range(11)]
    rows[5] = ("a", 9, rows[4][2], [x + 1e-9 for x in rows[4][3]])
    rows += [("a", 50, None, [1.0, 2.0, 3.0]), ("b", 51, [1.0, None, 3.0], [1.0, 2.0, 3.0])]
    gap = lambda p, q: math.sqrt(sum((s - t) ** 2 for s, t in zip(p, q)))
    whole = [x for x in rows if x[2] and None not in x[2]]
    want = np.mean([abs(gap(p[2], q[2]) - gap(p[3], q[3])) for p in whole for q in whole if p[0] == q[0]])
    d = spark.createDataFrame(rows, "b string, t long, o array<double>, y array<double>")
    for block in (3, 4096):
        assert abs(L.distance_over_time(d, ["b"], "t", "o", "y", block=block).first()["loss"] - want) < 1e-12
    assert L.distance_over_time(d.limit(0), ["b"], "t", "o", "y").first()["loss"] is None
    assert L.distance_over_time(d.where("b = 'a'"), [], "t", "o", "y").first()["loss"] is not None
