"""Queries on neighbours, clusters and segments of ``embeddings`` (frames in the order of vec_id), and on label sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import decompose as D
from ..operators import generate as G
from ..operators import neighbors as N
from ..operators import sampling as B
from ..operators import segment as S
from ..operators import sequence as Q
from ..operators import windows as W
from ..operators.blocks import indexed, running
from .signal_queries import _C, _r, samples, signal
from .window_queries import _E, _S, _X, _embeddings, _samples

SRC = ["event_type"]


def _knn(e, k=8, metric="euclidean"):
    return N.knn(e, e, "vec_id", "v", k, metric)


def knn_graph(spark, d):
    return _knn(_embeddings(spark, d)).select("src", F.col("rank").cast("long").alias("rank"), "dst", _r("dist").alias("dist"))


def knn_cosine(spark, d):
    return _knn(_embeddings(spark, d), 3, "cosine").select("src", F.col("rank").cast("long").alias("rank"), "dst", _r("dist").alias("dist"))


def radius_graph(spark, d):
    return N.radius_graph(_embeddings(spark, d), "vec_id", "v", 1.2).select("src", "dst", _r("dist").alias("dist"))


def all_distances(spark, d):
    """The sum, least and largest of the distances of each vector to all."""
    e = _embeddings(spark, d)
    return N.pairwise(e, e, "vec_id", "v", "cosine").groupBy("src").agg(_r(F.sum("dist")).alias("total"), _r(F.max("dist")).alias("most"), F.count("*").alias("n"))


def nearest_neighbor(spark, d):
    e = _embeddings(spark, d)
    return N.nearest_neighbor(e.where("label < 5"), e.where("label >= 5"), "vec_id", "v").select("src", "dst", _r("dist").alias("dist"))


def in_degrees(spark, d):
    return N.in_degree(_knn(_embeddings(spark, d))).select("dst", "n")


def core_points(spark, d):
    e = _embeddings(spark, d)
    n = e.select(F.col("vec_id").alias("dst")).join(N.in_degree(_knn(e)), "dst", "left").select("dst", F.coalesce("n", F.lit(0)).alias("n"))
    least = W.quantile(n, [], "n", {"q": 0.75})
    return n.join(F.broadcast(least), F.col("n") >= F.col("q")).select("dst", "n")


def nn_filter_median(spark, d):
    return N.neighbor_filter(_embeddings(spark, d), "vec_id", "v", 8).select("vec_id", "dim", _r("y").alias("y"))


def nearest_components(spark, d):
    """Components of the graph of each vector and its nearest."""
    e = _embeddings(spark, d)
    return C.connected_components(e, _knn(e, 1).select("src", "dst"), "vec_id")


def qcluster(spark, d):
    return C.qcluster(_embeddings(spark, d), "vec_id", "v", 0.25, 8, 2)


def hcluster(spark, d):
    return C.hcluster(_embeddings(spark, d), "vec_id", "v")


def kmeans(spark, d):
    return C.cluster(_embeddings(spark, d), "vec_id", "v", "kmeans", k=8, max_iter=20)


def gcluster(spark, d):
    return C.gcluster(_embeddings(spark, d), "vec_id", "v", n_means=8, n_iter=10)


def spectral(spark, d):
    return C.spectral(_embeddings(spark, d), "vec_id", "v", 4)


def single_linkage(spark, d):
    return C.single_linkage(_embeddings(spark, d), "vec_id", "v", 12)


def argmax_codes(spark, d):
    return C.arg_max_labels(_embeddings(spark, d), "vec_id", "v")


def pca(spark, d):
    """Scores on four axes: their variances sum up over rows to the largest eigenvalues."""
    return D.pca(_embeddings(spark, d), "v", 4).select("vec_id", F.posexplode("scores").alias("i", "y")).select("vec_id", "i", _r("y").alias("y"))


def nmf(spark, d):
    e = _embeddings(spark, d).withColumn("v", F.transform("v", F.abs))
    return D.nmf(e, "v", 4, max_iter=8).select("vec_id", F.posexplode("weights").alias("i", "y"))


def factor_analysis(spark, d):
    return D.factor_analysis(_embeddings(spark, d), "v", 4, max_iter=50).select("vec_id", F.posexplode("factors").alias("i", "y"))


def novelty_curve(spark, d):
    return S.novelty(indexed(_embeddings(spark, d), [], ["vec_id"]), [], "t", "v", [6, 2]).select("t", _r("score").alias("score"))


def novelty_cuts(spark, d):
    return S.cuts(indexed(_embeddings(spark, d), [], ["vec_id"]), [], "t", "v", [6])[0].select("t")


def novelty_peaks(spark, d):
    return S.cuts(indexed(_embeddings(spark, d), [], ["vec_id"]), [], "t", "v", [6])[1].select("t")


def peak_candidates(spark, d):
    return S.peak_candidates(samples(spark, d), SRC, "t", "x", 3, 4, 5, 2, 10.0).select("event_id", "candidate")


def attack_decay(spark, d):
    return Q.periods(samples(spark, d), SRC, "t", "x").select("event_type", "period", "attack", "peak")


def bounce_labels(spark, d):
    return S.by_labels(_embeddings(spark, d), "label", [1, 4]).select("vec_id", "label")


def bounce_segments(spark, d):
    s = S.segment_rows(samples(spark, d).withColumn("up", (F.col("x") > 0).cast("int")), SRC, "t", "up", 512, 16000).where("label = 0 and end_time - start_time > 0.05")
    return S.by_segments(samples(spark, d).select("event_type", "t", "event_id"), s, SRC, "t", 512, 16000).select("event_id", "segment_start")


def segment_times(spark, d):
    s = S.segment_rows(samples(spark, d).withColumn("up", (F.col("x") > 0).cast("int")), SRC, "t", "up", 512, 16000)
    return s.select("event_type", "seg_id", "label", "label_text", F.round("start_time", 8).alias("start_time"), F.round("end_time", 8).alias("end_time"))


def score_between(spark, d):
    return S.between(signal(spark, d), "x", -10.0, 25.5).select("event_id")


def export_pieces(spark, d):
    x = Q.cut_labels(samples(spark, d), SRC, "t", F.col("x") > 200)
    return S.export(x, SRC, "t", "x", "label", silence=3).select("event_type", "label", "t", _r("x").alias("x"))


def sample_cuts(spark, d):
    """Attacks by two levels of envelopes."""
    return S.sample_cuts(samples(spark, d), SRC, "t", "x", sensitivity=0.05, levels=[(64, 8, 3), (32, 8, 2), (16, 8, 2)])


def frames_sliding(spark, d):
    s = W.slices(samples(spark, d), SRC, "t", "x", 8, 3)
    return s.select("event_type", "start", F.posexplode("v").alias("i", "x")).select("event_type", "start", "i", _r("x").alias("x"))


def pair_input_target(spark, d):
    p = B.network_pairs(samples(spark, d), SRC, "t", "x", "wavenet", 8, 4, rf=3)
    return p.select("event_type", "start", F.element_at("inputs", -1).alias("last"), F.size("targets").alias("n"), F.posexplode("targets").alias("i", "x")).select("event_type", "start", _r("last").alias("last"), "n", "i", _r("x").alias("x"))


def tbptt_starts(spark, d):
    n = signal(spark, d).count()
    return B.tbptt_starts(spark, n, 4, 100, 20, 2).select(*[F.col(c).cast("long").alias(c) for c in ("batch", "step", "track", "start")])


def index_starts(spark, d):
    return B.index_starts(spark, [5, None, 17, None], 0, 1000, 8)


def drawn_batches(spark, d):
    return B.batches(_embeddings(spark, d).select("vec_id"), "vec_id", 32, seed=3, limit=10).select("vec_id", F.col("batch").cast("long").alias("batch"))


def consolidate_labels(spark, d):
    """Labels made distinct between sources and dense."""
    x = W.label_offsets(signal(spark, d), "event_type", "user_id")
    return Q.dense_codes(x, "label_all").select("event_id", "code")


def class_sizes(spark, d):
    return W.class_size(signal(spark, d), SRC, "user_id")


def entropy_signed(spark, d):
    x = W.running_entropy(_samples(spark, d), SRC, "t", "q")
    return W.signed_entropy(x, SRC, "t", "entropy").groupBy("event_type").agg(F.round(F.sum("signed"), 4).alias("total"))


def k_best(spark, d):
    """The ten sources of least entropy."""
    x = indexed(signal(spark, d), ["user_id"], ["ts", "event_id"])
    e = W.running_entropy(x, ["user_id"], "t", "event_type").groupBy("user_id").agg(_r(F.max_by("entropy", "t")).alias("entropy"))
    return N.best_k(e, "entropy", 10, key="user_id")


def epoch_means(spark, d):
    from ..sources.store import epoch_means as means

    m = signal(spark, d).select((F.col("event_id") % 7).alias("epoch"), F.col("event_type").alias("name"), F.col("x").alias("value"))
    return means(m, "epoch").select("epoch", "name", _r("mean").alias("mean"))


def spectrum_sums(spark, d):
    """The sum of each vector's components."""
    return _embeddings(spark, d).select("vec_id", _r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def seed_tails(spark, d):
    return G.tail(samples(spark, d), SRC, "t", "x", 5).select("event_type", "t", _r("x").alias("x"))


def transitions(spark, d):
    x = indexed(signal(spark, d), ["user_id"], ["ts", "event_id"])
    return G.transitions(x, ["user_id"], "t", "event_type")


def ngram_generate(spark, d):
    """Each user's last event followed eight times through the likeliest transitions."""
    x = indexed(signal(spark, d), ["user_id"], ["ts", "event_id"])
    starts = x.groupBy("user_id").agg(F.max_by("event_type", "t").alias("event_type")).select(F.col("user_id").alias("id"), "event_type")
    return G.walk(starts, G.likeliest(G.transitions(x, ["user_id"], "t", "event_type"), "event_type"), "event_type", 8)


def dtw_path(spark, d):
    """Five vectors of each label aligned with all vectors."""
    e = _embeddings(spark, d)
    q = indexed(e, ["label"], ["vec_id"]).where("t < 5")
    return N.align(q, e.select(F.col("vec_id").alias("t"), "v"), ["label"], "t", "v")


def nearest_next(spark, d):
    e = _embeddings(spark, d)
    q = indexed(e, ["label"], ["vec_id"]).where("t < 5")
    return G.nearest_next(q, e.select(F.col("vec_id").alias("t"), "v"), ["label"], "t", "v", 6)


def generate_means(spark, d):
    """Each vector's first eight components as a prompt, followed by means of the last four values."""
    e = _embeddings(spark, d).select("vec_id", F.slice("v", 1, 8).alias("v"))
    g = G.generate(e, ["vec_id"], "v", G.Stateless(4, lambda w: w.mean()), 3)
    return g.select("vec_id", F.posexplode("v").alias("i", "y")).select("vec_id", "i", _r("y").alias("y"))


def last_crossing(spark, d):
    """The place of the last upward crossing up to each sample."""
    z = Q.zero_crossings(samples(spark, d), SRC, "t", "x")
    return running(z, SRC, "t", F.when(F.col("up"), F.col("t")), "at", "max").select("event_id", "at")


QUERIES = {f.__name__: f for f in (knn_graph, knn_cosine, radius_graph, all_distances, nearest_neighbor, in_degrees, core_points, nn_filter_median, nearest_components, qcluster, hcluster, kmeans, gcluster, spectral, single_linkage,
                                   argmax_codes, pca, nmf, factor_analysis, novelty_curve, novelty_cuts, novelty_peaks, peak_candidates, attack_decay, bounce_labels, bounce_segments, segment_times, score_between, export_pieces,
                                   sample_cuts, frames_sliding, pair_input_target, tbptt_starts, index_starts, drawn_batches, consolidate_labels, class_sizes, entropy_signed, k_best, epoch_means, spectrum_sums, seed_tails,
                                   transitions, ngram_generate, dtw_path, nearest_next, generate_means, last_crossing)}

_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_COSD = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


def _near(k: int, dist: str, left: str = _E, right: str = _E) -> str:
    """(src, rank, dst, dist) of the k nearest."""
    return f"""(SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS rank, dst, dist FROM
(SELECT a.vec_id AS src, b.vec_id AS dst, {dist} AS dist FROM {left} a JOIN {right} b ON a.vec_id <> b.vec_id)) WHERE rank <= {k})"""


_G8 = _near(8, _DIST)
_N8 = f"(SELECT vec_id AS dst, count(src) AS n FROM {_E} LEFT JOIN {_G8} ON dst = vec_id AND dist > 0 GROUP BY vec_id)"
_CLOSURE = """c(v, r) AS (SELECT src, src FROM u UNION SELECT u.dst, c.r FROM c JOIN u ON u.src = c.v), m AS (SELECT v, min(r) AS component FROM c GROUP BY v)"""
_FR = f"(SELECT vec_id AS t, v FROM {_E})"


def _novelty(sizes: tuple[int, ...]) -> str:
    """(t, score) by the checkerboard over all offsets."""
    one = lambda h: f"""(SELECT t, s - min(s) OVER () AS s FROM (SELECT f.t, coalesce(sum(-sign(p.i - f.t) * sign(p.j - f.t) * p.dist / {(2 * h) ** 2}.0::DOUBLE), 0) AS s
FROM {_FR} f LEFT JOIN d p ON p.i BETWEEN f.t - {h} AND f.t + {h} AND p.j BETWEEN f.t - {h} AND f.t + {h} GROUP BY f.t))"""  # noqa: E731
    return f"(SELECT t, sum(s) / {len(sizes)} AS score FROM ({' UNION ALL '.join('SELECT * FROM ' + one(h) for h in sizes)}) GROUP BY t)"


_BAND = f"d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, {_COSD} AS dist FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <= 12)"
_RUNS = f"""(SELECT event_type, s AS seg_id, any_value(up) AS label, min(t) AS start, max(t) + 1 AS stop FROM (SELECT *, sum(k) OVER (PARTITION BY event_type ORDER BY t) - 1 AS s FROM
(SELECT event_type, t, CAST(x > 0 AS INTEGER) AS up, CASE WHEN (x > 0) IS DISTINCT FROM lag(x > 0) OVER (PARTITION BY event_type ORDER BY t) THEN 1 ELSE 0 END AS k FROM {_X})) GROUP BY ALL)"""
_U = "(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
_NEXT = f"(SELECT event_type, next, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY t) AS next FROM {_U}) WHERE next IS NOT NULL GROUP BY ALL)"
_W = "OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"

def _drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


ORACLE = {
    "tbptt_starts": f"""WITH n AS (SELECT count(*) AS n, greatest(1, count(*) // 100 - 1) AS c, greatest(1, count(*) % 100) AS r FROM events),
d AS (SELECT id, c, r, row_number() OVER (ORDER BY {_drawn("'0'", 'CAST(id AS VARCHAR)')}, id) - 1 AS place FROM (SELECT c, r, unnest(range(2 * c)) AS id FROM n))
SELECT place // 4 AS batch, CAST(step AS BIGINT) AS step, place % 4 AS track, id % c * 100 + CAST(floor({_drawn("'1'", 'CAST(id AS VARCHAR)')} * r) AS BIGINT) + step * 20 AS start FROM d, range(5) AS s(step)""",
    "index_starts": f"SELECT k, coalesce(g, CAST(floor({_drawn("'0'", 'CAST(k AS VARCHAR)', "'0'")} * 1000) AS BIGINT) // 8 * 8) AS start FROM (VALUES (0::BIGINT, 5::BIGINT), (1, NULL), (2, 17), (3, NULL)) AS v(k, g)",
    "drawn_batches": f"SELECT vec_id, place // 32 AS batch FROM (SELECT vec_id, row_number() OVER (ORDER BY {_drawn("'3'", 'CAST(vec_id AS VARCHAR)')}, vec_id) - 1 AS place FROM embeddings) WHERE place < 320",
    "novelty_peaks": f"""WITH RECURSIVE {_BAND}, s AS MATERIALIZED (SELECT *, max(score) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS top, avg(score) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS mean FROM {_novelty((6,))}),
c AS MATERIALIZED (SELECT t FROM s WHERE score = top AND score >= mean), p(t) AS (SELECT min(t) FROM c UNION ALL SELECT (SELECT min(c.t) FROM c WHERE c.t > p.t + 4) FROM p WHERE p.t IS NOT NULL) SELECT t FROM p WHERE t IS NOT NULL""",
    "knn_graph": f"SELECT src, rank, dst, round(dist, 6) AS dist FROM {_G8}",
    "knn_cosine": f"SELECT src, rank, dst, round(dist, 6) AS dist FROM {_near(3, _COSD)}",
    "radius_graph": f"SELECT src, dst, round(dist, 6) AS dist FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST} AS dist FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id) WHERE dist <= 1.2",
    "all_distances": f"SELECT a.vec_id AS src, round(sum({_COSD}), 6) AS total, round(max({_COSD}), 6) AS most, count(*) AS n FROM {_E} a, {_E} b GROUP BY a.vec_id",
    "nearest_neighbor": f"""SELECT src, dst, round(acos(1 - dist) / pi(), 6) AS dist FROM {_near(1, _COSD, f'(SELECT * FROM {_E} WHERE label < 5)', f'(SELECT * FROM {_E} WHERE label >= 5)')}""",
    "in_degrees": f"SELECT dst, n FROM {_N8} WHERE n > 0",
    "core_points": f"SELECT dst, n FROM {_N8} WHERE n >= (SELECT quantile_cont(n, 0.75) FROM {_N8})",
    "nn_filter_median": f"""WITH g AS MATERIALIZED (SELECT src, dst FROM {_G8}), m AS (SELECT a.src, a.dst FROM g a JOIN g b ON b.src = a.dst AND b.dst = a.src),
y AS (SELECT m.src, i, median(v[i]) AS y FROM m JOIN {_E} e ON e.vec_id = m.dst, range(1, 65) AS r(i) GROUP BY ALL)
SELECT e.vec_id, CAST(r.i - 1 AS INTEGER) AS dim, round(coalesce(y, v[r.i]), 6) AS y FROM {_E} e, range(1, 65) AS r(i) LEFT JOIN y ON y.src = e.vec_id AND y.i = r.i""",
    "nearest_components": f"""WITH RECURSIVE g AS MATERIALIZED (SELECT src, dst FROM {_near(1, _DIST)}), u AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g), {_CLOSURE} SELECT v AS vec_id, component FROM m""",
    "qcluster": f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_N8}), k AS MATERIALIZED (SELECT e.* FROM {_E} e JOIN n ON n.dst = e.vec_id WHERE n.n >= (SELECT quantile_cont(n, 0.75) FROM n)),
g AS MATERIALIZED (SELECT src, dst FROM {_near(2, _DIST, 'k', 'k')} WHERE dist > 0 UNION SELECT src, dst FROM {_near(1, _DIST, f'(SELECT * FROM {_E} WHERE vec_id NOT IN (SELECT vec_id FROM k))', 'k')}),
u AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g), {_CLOSURE} SELECT v AS vec_id, v IN (SELECT vec_id FROM k) AS is_core, dense_rank() OVER (ORDER BY component) - 1 AS label FROM m""",
    "argmax_codes": f"SELECT vec_id, dense_rank() OVER (ORDER BY list_position(v, list_max(v))) - 1 AS label FROM {_E}",
    "novelty_curve": f"WITH {_BAND} SELECT t, round(score, 6) AS score FROM {_novelty((6, 2))}",
    "peak_candidates": f"SELECT event_id, x = max(x) {_W.format(3, 3)} AND x >= avg(x) {_W.format(5, 1)} + 10 AS candidate FROM {_X}",
    "attack_decay": f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, lag(x) {_W.format(1, 0).split(' ROWS')[0]}) < 0 AND x > 0 AS up, x > 0 AND lead(x) {_W.format(1, 0).split(' ROWS')[0]}) < 0 AS turn FROM {_X}),
p AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t) AS p FROM s)
SELECT event_type, CAST(p AS BIGINT) AS period, min(t) AS attack, coalesce(min(t) FILTER (turn AND t < n - 2), max(n) - 1) AS peak FROM p WHERE p > 0 GROUP BY event_type, p""",
    "bounce_labels": "SELECT vec_id, label FROM embeddings WHERE label IN (1, 4)",
    "bounce_segments": f"SELECT s.event_id, start AS segment_start FROM {_RUNS} r JOIN {_X} s ON s.event_type = r.event_type AND s.t >= r.start AND s.t < r.stop WHERE r.label = 0 AND stop - start >= 2",
    "segment_times": f"SELECT event_type, CAST(seg_id AS BIGINT) AS seg_id, label, CAST(label AS VARCHAR) AS label_text, round(start * 512 / 16000.0::DOUBLE, 8) AS start_time, round(stop * 512 / 16000.0::DOUBLE, 8) AS end_time FROM {_RUNS}",
    "score_between": f"SELECT event_id FROM {_C} WHERE x > -10 AND x < 25.5",
    "export_pieces": f"""WITH l AS (SELECT event_type, t, x, CAST(sum(CASE WHEN x > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS label FROM {_X})
SELECT event_type, label, t - min(t) OVER (PARTITION BY event_type, label) AS t, round(x, 6) AS x FROM l UNION ALL SELECT event_type, label, n + k, 0 FROM (SELECT event_type, label, count(*) AS n FROM l GROUP BY ALL), range(3) AS r(k)""",
    "frames_sliding": f"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM {_X})
SELECT s.event_type, s.t AS start, CAST(k AS INTEGER) AS i, round(v.x, 6) AS x FROM a s, range(8) AS r(k) JOIN a v ON v.event_type = s.event_type AND v.t = s.t + k WHERE s.t % 3 = 0 AND s.t + 7 < s.n""",
    "pair_input_target": f"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM {_X})
SELECT s.event_type, s.t AS start, round(e.x, 6) AS last, 6::INTEGER AS n, CAST(k AS INTEGER) AS i, round(v.x, 6) AS x FROM a s JOIN a e ON e.event_type = s.event_type AND e.t = s.t + 7, range(6) AS r(k) JOIN a v ON v.event_type = s.event_type AND v.t = s.t + 3 + k
WHERE s.t % 4 = 0 AND s.t + 8 < s.n""",
    "consolidate_labels": "SELECT event_id, dense_rank() OVER (ORDER BY event_type, user_id) - 1 AS code FROM events",
    "class_sizes": "SELECT event_type, max(user_id) + 1 AS class_size FROM events GROUP BY 1",
    "entropy_signed": f"""WITH c AS (SELECT s.event_type, s.t, e.q, count(*)::DOUBLE / (s.t + 1) AS p FROM {_S} s JOIN {_S} e ON e.event_type = s.event_type AND e.t <= s.t GROUP BY s.event_type, s.t, e.q),
h AS (SELECT event_type, t, -sum(p * ln(p)) AS h FROM c GROUP BY ALL), n AS (SELECT *, lead(h, 1, 0.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY t) AS n FROM h)
SELECT event_type, round(sum(CASE WHEN abs(n - h) < 1e-13 THEN 0 ELSE sign(n - h) * h END), 4) AS total FROM n GROUP BY 1""",
    "k_best": """SELECT user_id, round(-sum(share * ln(share)), 6) AS entropy FROM (SELECT user_id, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY user_id, event_type) GROUP BY 1 ORDER BY 2, 1 LIMIT 10""",
    "epoch_means": f"SELECT event_id % 7 AS epoch, event_type AS name, round(avg(x), 6) AS mean FROM {_C} GROUP BY ALL",
    "spectrum_sums": f"SELECT vec_id, round(list_sum(v), 6) AS total FROM {_E}",
    "seed_tails": f"SELECT event_type, 4 - (n - 1 - t) AS t, round(x, 6) AS x FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM {_X}) WHERE t >= n - 5",
    "transitions": f"SELECT * FROM {_NEXT}",
    "ngram_generate": f"""WITH RECURSIVE b AS MATERIALIZED (SELECT event_type, next FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, next) AS r FROM {_NEXT}) WHERE r = 1),
w(id, step, event_type) AS (SELECT user_id, 0, arg_max(event_type, t) FROM {_U} GROUP BY 1 UNION ALL SELECT id, step + 1, next FROM w JOIN b USING (event_type) WHERE step < 8) SELECT id, CAST(step AS INTEGER) AS step, event_type FROM w""",
    "generate_means": f"""WITH a AS (SELECT vec_id, v, (v[5] + v[6] + v[7] + v[8]) / 4 AS m FROM {_E}), b AS (SELECT *, (v[6] + v[7] + v[8] + m) / 4 AS n FROM a), c AS (SELECT *, (v[7] + v[8] + m + n) / 4 AS o FROM b)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN i < 8 THEN v[i + 1] WHEN i = 8 THEN m WHEN i = 9 THEN n ELSE o END, 6) AS y FROM c, range(11) AS r(i)""",
    "last_crossing": f"SELECT event_id, max(CASE WHEN up THEN t END) OVER (PARTITION BY event_type ORDER BY t) AS at FROM (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY t) < 0 AND x > 0 AS up FROM {_X})",
}
