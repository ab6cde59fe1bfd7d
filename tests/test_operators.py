"""Unit tests: goldens, invariants, error cases and differential tests against numpy."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.functions import vec
from matchlight.metric import dense, learners, protocol
from matchlight.operators import bow, cov, evaluate, features, folds, kmeans, knn, pairs, pca, pixels, score, strips, superpixel
from matchlight.plans import pipeline
from matchlight.sources import images, mat5
from matchlight.streaming import rank_stream


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def labelled(spark, n=120, d=5, people=6, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(people, d)) * 2
    rows = [(i, int(i % people), int(i // people % 2), i % 5 == 0, [float(v) for v in centre[i % people] + r.normal(size=d)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, person int, cam int, is_query boolean, x array<double>"), rows


# k-means


def test_kmeans_degenerate(spark):
    c = kmeans.fit(points(spark, [(1959, 325100), (1960, 373200)]), 1)
    assert c == pytest.approx(np.array([[1959.5, 349150]]))


@pytest.mark.parametrize("strategy", ["largest_variance", "largest_points_number", "farthest_point"])
@pytest.mark.parametrize("k", [2, 7])
def test_kmeans_certain_space(spark, strategy, k):
    x = np.array([[(1 + 27 * i + 27 * j) * 1e6 for j in range(4)] for i in range(27)])
    c = kmeans.fit(points(spark, x), k, 20, strategy)
    a = kmeans.assign(points(spark, x), c).groupBy("cluster").count().collect()
    assert len(c) == k and sum(r["count"] for r in a) == 27 and len(a) == k


def test_kmeans_unique_point_among_copies_is_a_seed(spark):
    x = points(spark, [(0.0,)] * 500 + [(1.0,)])
    assert sorted(kmeans.seed(x, 2).ravel().tolist()) == [0.0, 1.0]


def test_kmeans_errors_and_reseeding(spark):
    x = points(spark, [(0.0,), (1.0,), (5.0,)])
    for k in (0, 4):
        with pytest.raises(ValueError):
            kmeans.fit(x, k)
    with pytest.raises(ValueError):
        kmeans.fit(x, 1, strategy="none")
    with pytest.raises(kmeans.EmptyClusterError):
        kmeans.fit(x, 2, 5, "error", centres=[[0.0], [100.0]])
    c = kmeans.fit(x, 2, 5, "farthest_point", centres=[[0.0], [100.0]])
    assert sorted(c.ravel().tolist()) == [0.5, 5.0]
    assert kmeans.fit(points(spark, [(1.0,), (2.0,), (-3.0,)]), 1).ravel().tolist() == [0.0]
    assert sorted(kmeans.fit(x, 3).ravel().tolist()) == [0.0, 1.0, 5.0]


def test_kmeans_equals_lloyd_in_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 3))
    c = x[:4].copy()
    got = kmeans.fit(points(spark, x), 4, 5, centres=c)
    for _ in range(5):
        a = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        c = np.array([x[a == k].mean(0) for k in range(4)])
    assert got == pytest.approx(c)


# Principal components and covariances


def test_pca_golden(spark):
    x = points(spark, [(1, 3, 5, 7), (2, 4, 6, 8)])
    mean, rows, values = pca.fit(x, F.col("x"))
    assert values[0] == pytest.approx(2, abs=1e-3)
    got = sorted(r["y"][0] for r in x.select(pca.transform(x, F.col("x"), mean, rows, 1).alias("y")).collect())
    assert got == pytest.approx([-1, 1], abs=1e-3)


def test_scatter_and_class_sums(spark):
    s, rows = labelled(spark)
    x = np.array([r[4] for r in rows])
    m = cov.to_matrix(cov.scatter(s, F.col("x")), mean=False)
    assert m == pytest.approx(x.T @ x)
    pos = [(a, b) for a, b in itertools.product(rows, rows) if a[1] == b[1] and a[2] == 0 and b[2] == 1]
    d = np.array([np.subtract(a[4], b[4]) for a, b in pos])
    c = cov.class_pair_scatter(s, F.col("x"))
    assert cov.to_matrix(c, mean=False) == pytest.approx(d.T @ d) and c.first()["n"] == len(pos)
    w = cov.to_matrix(cov.scatter(s, F.col("x"), F.col("id") + 1.0))
    k = np.arange(len(rows)) + 1.0
    assert w == pytest.approx((x * k[:, None]).T @ x / k.sum())
    assert cov.scatter(s.limit(0), F.col("x")).count() == 0


# Metrics


def test_metrics(spark):
    s, rows = labelled(spark)
    _, m = pipeline.train_metric(s, "kissme")
    assert m == pytest.approx(m.T) and np.linalg.eigvalsh(m).min() > -1e-9
    for name in ("mahal", "xqda", "l2"):
        _, m = pipeline.train_metric(s, name)
        assert m == pytest.approx(m.T, abs=1e-8)
    p, n = np.diag([1.0, 2.0]), np.diag([4.0, 3.0])
    assert learners.kissme(p, n) == pytest.approx(np.diag([1 - 1 / 4, 1 / 2 - 1 / 3]))
    assert dense.psd(np.diag([1.0, -1.0])) == pytest.approx(np.diag([1.0, 1e-6]))
    assert dense.inverse(np.diag([2.0, 0.0])) == pytest.approx(np.diag([0.5, 0.0]))
    l = dense.factor(np.array([[2.0, 1.0], [1.0, 2.0]]))
    assert l.T @ l == pytest.approx(np.array([[2.0, 1.0], [1.0, 2.0]]))
    w, m = learners.xqda(s)
    assert w.shape[0] == 5 and m.shape[0] == w.shape[1]


def test_evaluation_under_a_metric(spark):
    s, _ = labelled(spark)
    moved, m = pipeline.train_metric(s, "kissme", dims=3)
    ap, cmc = pipeline.evaluate_metric(moved, m, 5)
    rates = [r["rate"] for r in cmc.orderBy("rank").collect()]
    assert 0.3 < ap.first()["map"] <= 1 and rates == sorted(rates) and len(rates) == 5


def test_itml_meets_its_constraints(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(20, 2)) * [5, 0.3], r.normal(size=(20, 2)) * [5, 0.3] + [0, 3]])
    y = [0] * 20 + [1] * 20
    rng = random.Random(1)
    c = [(i, j, 1, 4.0) if y[i] == y[j] else (i, j, -1, 8.0) for i, j in ((rng.randrange(40), rng.randrange(40)) for _ in range(200)) if i != j]
    m = learners.itml(x, c, gamma=10.0)
    assert m == pytest.approx(m.T) and np.linalg.eigvalsh(m).min() > 0 and m[1, 1] > m[0, 0]


def test_gradient_bins_at_cuts_agree_with_sql(spark):
    """Grey values a, b, c, d whose roots' gradient points at 120 or 240 degrees, where the last bit decides."""
    import duckdb
    import pandas as pd

    from matchlight.plans import oracles as O

    root = np.sqrt(np.arange(256.0))
    slopes = {}
    for a, b in itertools.product(range(256), repeat=2):
        slopes.setdefault(root[a] - root[b], (a, b))
    values = np.array(sorted(slopes))
    rows = []
    for iy in values[values != 0]:
        ix = -abs(iy) / 3**0.5
        for v in values[np.searchsorted(values, ix - 1e-13 * max(1, -ix)) : np.searchsorted(values, ix + 1e-13 * max(1, -ix))]:
            (right, left), (down, up), image = slopes[iy], slopes[v], len(rows) // 9
            rows += [(image, r, c, g, 0) for r, line in enumerate(((0, up, 0), (left, 0, right), (0, down, 0))) for c, g in enumerate(line)]
    assert len(rows) > 60_000
    x = pd.DataFrame(rows, columns=["image_id", "row", "col", "gray", "sp"]).astype({"row": "int32", "col": "int32"})
    con = duckdb.connect()
    con.register("grey", x)
    want = con.sql(f"WITH slopes AS ({O.CTE['slopes'][0]}), grads AS ({O.CTE['grads'][0]}) SELECT image_id, row, col, bin, magnitude FROM grads ORDER BY ALL").df()
    got = pixels.gradients(spark.createDataFrame(x.assign(red=x.gray, green=x.gray, blue=x.gray)))
    assert got.where("gray <> red").count() == 0
    got = got.select("image_id", "row", "col", "bin", "magnitude").toPandas().sort_values(["image_id", "row", "col"]).reset_index(drop=True)
    assert (got.bin == want.bin).all() and (got.magnitude == want.magnitude).all()


def test_label_pair_mean_makes_no_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 5 if i % 11 else None, i % 3, [float(v) for v in 1e6 + r.normal(size=4)]) for i in range(90)]
    s = spark.createDataFrame(rows, "id long, person int, cam int, x array<double>")
    x = np.array([v[3] for v in rows])
    d = np.array([x[i] - x[j] for i, j in itertools.combinations(range(90), 2) if rows[i][1] is not None and rows[i][1] == rows[j][1] and rows[i][2] != rows[j][2]])
    assert cov.label_pair_mean(s) == pytest.approx(d.T @ d / len(d), rel=1e-7, abs=1e-7)
    assert cov.label_pair_mean(s.where("cam = 0")).size == cov.label_pair_mean(s.where("false")).size == 0
    pos, neg = learners.sample_covariances(s, 3)
    assert pos.shape == neg.shape == (4, 4)


def test_covariance_learners_make_no_positive_pairs(spark, monkeypatch):
    s, _ = labelled(spark)
    both = pairs.positives(s).select("x_a", "x_b", F.lit(True).alias("match")).unionByName(pairs.negatives(s).select("x_a", "x_b", F.lit(False).alias("match")))
    want = learners.mahalanobis(learners.pair_covariances(both)[0])
    monkeypatch.setattr(pairs, "positives", lambda *_: pytest.fail("pairs were made"))
    assert protocol.mahalanobis().fit_labels(s).m == pytest.approx(want)
    assert pipeline.train_metric(s, "mahal")[1] == pytest.approx(want)


def test_pair_distances_equal_the_expression(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 2 == 0, [float(v) for v in r.normal(size=3)], [float(v) for v in r.normal(size=3)]) for i in range(40)]
    p = spark.createDataFrame(rows, "key long, match boolean, x_a array<double>, x_b array<double>")
    m = r.normal(size=(3, 3))
    want = {v["key"]: v["d"] for v in p.select("key", vec.mahalanobis(F.col("x_a"), F.col("x_b"), vec.matrix(m)).alias("d")).collect()}
    got = {v["key"]: v["distance"] for v in score.pair_distances(p, m, ("key", "match")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("blocks", [8, 0])
def test_scored_positives_are_the_positives(spark, monkeypatch, blocks):
    monkeypatch.setattr(score, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(score, "BLOCK", 16)
    monkeypatch.setattr(score, "PART", 50)
    s, _ = labelled(spark)
    s = s.withColumn("person", F.when(F.col("id") % 7 > 0, F.col("person")))
    want = {(v["id_a"], v["id_b"]): v["d"] for v in pairs.positives(s).select("id_a", "id_b", vec.euclidean(F.col("x_a"), F.col("x_b")).alias("d")).collect()}
    got = score.positives(s, vec.euclidean).collect()
    assert len(got) == len(want) and {(v["id_a"], v["id_b"]): v["score"] for v in got} == pytest.approx(want)


def test_instances_of_balanced_pairs_without_pairs(spark, monkeypatch):
    s, _ = labelled(spark, 60)
    s = s.withColumn("person", F.when(F.col("id") != 7, F.col("person")))  # a row without a person is in no pair
    told = lambda x: sorted((r["person"], r["id"]) for r in x.collect())
    want = told(pairs.instances(pairs.balanced(s), s))
    one_camera = s.where("person <> 2 or cam = 0")
    assert told(pairs.balanced_instances(one_camera)) == told(pairs.instances(pairs.balanced(one_camera), one_camera))
    monkeypatch.setattr(pairs, "balanced", lambda *_: pytest.fail("pairs were made"))
    assert told(pairs.balanced_instances(s)) == want and len(want) == 59


def test_conjugate_gradient():
    a = np.diag([1.0, 10.0, 100.0])
    x, told = learners.conjugate_gradient(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(3), 200)
    assert x == pytest.approx(1 / np.diag(a), abs=1e-3) and told == sorted(told, reverse=True)


def test_ldml_lowers_its_objective(spark):
    s, _ = labelled(spark, 60, 3, 3)
    p = pairs.positives(s).select("x_a", "x_b", F.lit(True).alias("match")).unionByName(pairs.negatives(s).select("x_a", "x_b", F.lit(False).alias("match")))
    l, b, told = learners.ldml(p, 3, np.eye(3), steps=4)
    assert told == sorted(told, reverse=True) and told[-1] < told[0]


def test_lmnn_pulls_targets(spark):
    s, _ = labelled(spark, 60, 3, 3)
    l, told = learners.lmnn(s, 2, steps=3)
    assert l.shape == (3, 3) and min(told) <= told[0]


# Evaluation


def loop_ap(flags):
    """Average precision of a ranked list of good flags, junk removed."""
    good, ap, old_r, old_p, hit = sum(flags), 0.0, 0.0, 1.0, 0
    for j, f in enumerate(flags):
        hit += f
        r, p = hit / good, hit / (j + 1)
        ap += (r - old_r) * (old_p + p) / 2
        old_r, old_p = r, p
        if hit == good:
            break
    return ap


def test_average_precision_equals_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(30):
        ranked = [(rng.choice((0, 1, 2, -1)), rng.choice((0, 1))) for _ in range(40)]
        rows += [(q, 1, 0, g, p, c, float(40 - g)) for g, (p, c) in enumerate(ranked)]
        flags = [p == 1 for p, c in ranked if not (p == 1 and c == 0 or p == -1)]
        want[q] = loop_ap(flags) if any(flags) else None
    s = spark.createDataFrame(rows, "probe_id int, probe_person int, probe_cam int, gallery_id int, gallery_person int, gallery_cam int, score double")
    got = {r["probe_id"]: r["ap"] for r in evaluate.average_precision(s).collect()}
    assert {k: v for k, v in got.items()} == pytest.approx(want)
    up = {r["probe_id"]: r["ap"] for r in evaluate.average_precision(s.withColumn("score", -F.col("score")), "worst_first").collect()}
    assert up == pytest.approx(want)


def test_ties_are_optimistic(spark):
    s = spark.createDataFrame([(0, 0, 0, True, 1.0), (0, 0, 1, False, 1.0), (0, 1, 0, False, 0.5), (0, 1, 1, True, 0.1)], "trial int, probe int, gallery int, match boolean, score double")
    assert sorted(r["r"] for r in evaluate.optimistic_ranks(s, "probe").collect()) == [1, 2]
    curve = [r["rate"] for r in evaluate.symmetric_cmc(s, 2).orderBy("rank").collect()]
    assert curve == [0.5, 1.0]


def test_closed_set_needs_a_match(spark):
    s = spark.createDataFrame([(0, 0, True, 1.0), (1, 0, False, 1.0)], "probe int, gallery int, match boolean, score double")
    with pytest.raises(ValueError):
        evaluate.closed_set_cmc(s, 1)


def test_roc_of_a_perfect_order(spark):
    s = spark.createDataFrame([(i, float(i), i < 5) for i in range(10)], "key long, distance double, match boolean")
    p = [(r["tpr"], r["fpr"]) for r in evaluate.roc(s).orderBy("k").collect()]
    assert p[0] == (0, 0) and p[5] == (1, 0) and p[-1] == (1, 1)
    assert evaluate.equal_error(evaluate.roc(s)).first()["eer"] == 0


def test_cross_validation_over_folds(spark):
    s, _ = labelled(spark)
    p = pairs.positives(s).select("id_a", "x_a", "x_b", F.lit(True).alias("match")).unionByName(pairs.negatives(s).select("id_a", "x_a", "x_b", F.lit(False).alias("match")))
    p = p.withColumns({"fold": (F.col("id_a") % 2).cast("int"), "key": F.monotonically_increasing_id()})
    x = evaluate.fold_errors(pipeline.cross_validate(p, learners.kissme, [0, 1]))
    assert all(0 <= r["eer"] < 0.5 for r in x.collect())


@pytest.mark.parametrize("most", [8, 2, 1])
def test_many_probe_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(score, "BROADCAST_BLOCKS", most)
    rows = [(i, i % 3, i % 2, [float(i % 7), float(i % 5)]) for i in range(700)]
    s = spark.createDataFrame(rows, "id long, person int, cam int, x array<double>")
    got = {(r["probe_id"], r["gallery_id"]): r["score"] for r in score.score(s, s.where("id < 3")).collect()}
    assert score.score(s.limit(0), s).count() == score.score(s, s.limit(0)).count() == 0
    assert len(got) == 2100 and all(v == sum(a * b for a, b in zip(rows[p][3], rows[g][3])) for (p, g), v in got.items())


def test_energy_and_votes(spark):
    s, _ = labelled(spark, 90, 4, 3)
    near = knn.neighbours(s.where("is_query"), s.where("not is_query"), 3)
    assert knn.error_rate(near, (1, 3)).agg(F.max("error")).first()[0] < 0.6
    e = knn.energy_classify(s.where("is_query"), s.where("not is_query"), 3)
    assert e.where("truth = label").count() / e.count() > 0.5
    tied = spark.createDataFrame([(0, 9, 1, 1), (0, 9, 0, 2)], "test int, truth int, label int, rk int")
    assert knn.vote(tied, 2).first()["label"] == 0 and knn.vote(tied, 2, 0.01).first()["label"] == 1


# Images


def raster(spark, h=16, w=16, seed=0, images_=2):
    r = np.random.default_rng(seed)
    rows = [(i, y, x, *(int(v) for v in r.integers(0, 256, 3)), int(r.choice([0, 56, 136]))) for i in range(images_) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, row int, col int, red int, green int, blue int, mask int")


def test_histograms_have_unit_mass(spark):
    sp = superpixel.patches(raster(spark), 4, 16)
    for long in (features.hsv(sp), features.hog(sp), features.siltp(sp, (1, 2))):
        mass = long.groupBy("image_id", "sp").agg(F.sum(F.col("v") * F.col("v")).alias("m")).collect()
        assert len(mass) == 32 and all(r["m"] == pytest.approx(1) for r in mass)


def test_slic_covers_the_image_in_connected_pieces(spark):
    rows = {(r["image_id"], r["row"], r["col"]): r["sp"] for r in superpixel.slic(raster(spark), 16, 10.0).collect()}
    assert len(rows) == 512
    for i in (0, 1):
        for k in {v for (a, _, _), v in rows.items() if a == i}:
            cells = {(y, x) for (a, y, x), v in rows.items() if a == i and v == k}
            reach, todo = set(), [next(iter(cells))]
            while todo:
                y, x = todo.pop()
                if (y, x) in cells and (y, x) not in reach:
                    reach.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            assert reach == cells


def test_seed_table_equals_the_closed_form(spark):
    for w, h, n in ((192, 512, 500), (64, 48, 30), (10, 10, 200), (7, 5, 1)):
        step, at = superpixel.seed_grid(w, h, n)
        assert sorted((r["x"], r["y"]) for r in superpixel.seeds(spark, w, h, n).collect()) == sorted(at)


def test_resizing(spark):
    p = raster(spark, 4, 4, images_=1)
    assert pixels.resize_nearest(p, 4).count() == 256
    flat = p.withColumns({c: F.lit(77) for c in pixels.RGB})
    out = pixels.resize_bicubic(flat, 4)
    assert out.count() == 256 and out.where("red <> 77 or green <> 77 or blue <> 77").count() == 0


@pytest.mark.parametrize("pooling", ["mean", "max", "min"])
def test_bag_of_words_end_to_end(spark, pooling):
    s = pipeline.Settings(width=16, height=16, patch=4, words=4, top=2, strip=8, step=8, shift=2, radii=(1, 2), segment="patch", types=("HSV", "HOG"), pooling=pooling, word_level=pooling == "max")
    p = raster(spark)
    algorithm = pipeline.BagOfWords(s)
    book = algorithm.train(p)
    assert book.groupBy("type").count().where("count <> 4").count() == 0
    x = algorithm.test(p).collect()
    n = (1 if s.word_level else 2) * 2 * 4
    assert len(x) == 2 and all(len(r["x"]) == n and np.linalg.norm(r["x"]) == pytest.approx(1) for r in x)


def test_votes_prefer_near_then_low_words(spark):
    f = spark.createDataFrame([(0, 0, "HOG", [0.0, 0.0])], "image_id long, sp int, type string, feat array<double>")
    c = spark.createDataFrame([("HOG", 2, [0.0, 1.0]), ("HOG", 1, [1.0, 0.0]), ("HOG", 0, [3.0, 0.0])], "type string, word int, center array<double>")
    assert [r["word"] for r in bow.votes(f, c, 2).orderBy("rank").collect()] == [1, 2]
    m = vec.matrix([[4.0, 0.0], [0.0, 1.0]])
    assert [r["distance"] for r in bow.votes(f, c, 2, m).orderBy("rank").collect()] == [1.0, 2.0]


def test_a_large_codebook_is_met_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    f = spark.createDataFrame([(i, 0, "HOG", [float(v) for v in r.normal(size=2)]) for i in range(20)], "image_id long, sp int, type string, feat array<double>")
    c = spark.createDataFrame([("HOG", w, [float(v) for v in r.normal(size=2)]) for w in range(50)], "type string, word int, center array<double>")
    key = lambda r: (r["image_id"], r["rank"], r["word"], round(r["distance"], 9))
    want = sorted(map(key, bow.votes(f, c, 4).collect()))
    monkeypatch.setattr(bow, "BROADCAST_WORDS", 10)
    monkeypatch.setattr(bow, "BLOCK_WORDS", 8)
    assert sorted(map(key, bow.votes(f, c, 4).collect())) == want and len(want) == 80


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    x = r.select(vec.l2_normalise(F.col("a")).alias("n"), vec.l2_normalise(F.col("z")).alias("nan"), vec.euclidean(F.col("a"), F.col("b")).alias("e"), vec.mahalanobis(F.col("a"), F.col("b"), vec.matrix([[1, 0], [0, -9]])).alias("m"), vec.hellinger(F.col("a")).alias("h"), F.array(*vec.opq([F.col("a"), F.col("b"), F.array(F.lit(5.0), F.lit(6.0))], vec.matrix(np.eye(8).tolist()), 4)).alias("o")).first()
    assert x["n"] == pytest.approx([0.6, 0.8]) and np.isnan(x["nan"]).all() and x["e"] == pytest.approx(8**0.5) and x["m"] == 0.0
    assert x["h"] == pytest.approx([(3 / 7) ** 0.5, (4 / 7) ** 0.5]) and x["o"] == [[3.0, 4.0], [1.0, 2.0], [5.0, 6.0], [0.0, 0.0]]


def test_strips_of_a_tall_image(spark):
    sp = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (0, 2, 15)], "image_id long, sp int, row int")
    got = sorted((r["strip"], r["sp"]) for r in strips.strips(sp, 16, 8, 4).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]


# Sources


def test_mat5_round_trip(tmp_path, spark):
    values = {"a": np.arange(8.0).reshape(2, 4), "i": np.array([[1, -2]], np.int16), "f": np.array([[1.5]], np.float32), "t": "text", "c": [np.ones((1, 2)), "x"], "s": {"p": np.zeros((2, 1)), "q": "z"}, "z": np.array([[1 + 2j]])}
    for compress in (True, False):
        back = mat5.loads(mat5.dumps(values, compress))
        assert back["a"] == pytest.approx(values["a"]) and back["i"].dtype == np.int16 and back["t"] == "text" and back["s"]["q"] == "z" and back["z"][0, 0] == 1 + 2j
        assert back["c"].ravel()[1] == "x"
    e = mat5.sparse("sp", np.array([1, 0]), np.array([0, 2]), np.array([5.0, 7.0]), (2, 3))
    assert mat5.loads(mat5.dumps({"sp": e}))["sp"].tolist() == [[0, 0, 7], [5, 0, 0]]
    with pytest.raises(ValueError):
        mat5.loads(b"no")
    (tmp_path / "x.mat").write_bytes(mat5.dumps(values))
    t = mat5.read(spark, str(tmp_path / "x.mat"), "a")
    assert sorted((r["row"], r["col"], r["value"]) for r in t.collect()) == [(i, j, float(4 * i + j)) for i in range(2) for j in range(4)]
    spark.dataSource.register(mat5.Mat5DataSource)
    assert spark.read.format("mat5").option("path", str(tmp_path / "x.mat")).option("names", "a,t").load().count() == 9
    t.select("name", "row", "col", "value").write.format("mat5").option("path", str(tmp_path / "y.mat")).mode("append").save()
    assert mat5.loads((tmp_path / "y.mat").read_bytes())["a"] == pytest.approx(values["a"])
    (tmp_path / "b.mat").write_bytes(mat5.dumps({"codebook_HSV": np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])}))
    b = mat5.read(spark, str(tmp_path / "b.mat"))
    assert {r["word"]: r["center"] for r in mat5.codebook(b).collect()} == {0: [1, 2], 1: [3, 4], 2: [5, 6]}
    assert {r["word"]: r["center"] for r in mat5.codebook(b, "columns").collect()} == {0: [1, 3, 5], 1: [2, 4, 6]}


def bmp(pixels_):
    h, w = len(pixels_), len(pixels_[0])
    body = b"".join(b"".join(bytes(p) for p in row).ljust((w * 3 + 3) // 4 * 4, b"\0") for row in reversed(pixels_))
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_image_scan(spark, tmp_path):
    (tmp_path / "img_002.bmp").write_bytes(bmp([[(1, 2, 3), (4, 5, 6)]]))
    (tmp_path / "img_001.bmp").write_bytes(bmp([[(9, 8, 7)], [(6, 5, 4)]]))
    (tmp_path / "note.txt").write_text("no image")
    x = images.scan(spark, str(tmp_path))
    assert [r["name"] for r in x.collect()] == ["img_001.bmp", "img_002.bmp"]
    p = images.pixels(x.where("name = 'img_002.bmp'")).orderBy("col").collect()
    assert [(r["red"], r["green"], r["blue"]) for r in p] == [(3, 2, 1), (6, 5, 4)]
    assert images.scan(spark, str(tmp_path), "*_002.bmp").count() == 1
    assert images.with_masks(x, x, "viper").count() == 2
    assert sorted(r["id"] for r in images.listing(spark, str(tmp_path), "*.bmp").collect()) == ["img_", "img_"]


@pytest.mark.parametrize(
    "dataset, name, want",
    [
        ("viper", "045_90.bmp", ("045", None, None)),
        ("market", "0002_c1s1_000451_03.jpg", ("0002", "c1", None)),
        ("market_eval", "0002_c3s1_000451_03.jpg", ("0002", "3", None)),
        ("cuhk01", "0007003.png", ("0007", "2", None)),
        ("prid450s", "img_0012.bmp", ("0012", None, None)),
        ("cuhk03", "3_17_06.png", ("17", "2", "3")),
        ("cuhk03", "3_17_5.png", ("17", "1", "3")),
    ],
)
def test_names(spark, dataset, name, want):
    row = spark.createDataFrame([(name,)], "n string").select(*[c.alias(k) for c, k in zip(images.identity(F.col("n"), dataset), "abc")]).first()
    assert tuple(row) == want


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2.5\n 3  4\n\n")
    assert [r["x"] for r in images.text_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.5], [3.0, 4.0]]
    h = spark.createDataFrame([([1.0, 2.5],)], "h array<double>")
    assert images.histogram_lines(h, "h").first()["value"] == "1.0,2.5"
    assert zlib.crc32(b"") == 0


def test_rank_stream(spark, tmp_path):
    s, _ = labelled(spark, 60)
    s.where("is_query").select("id", "person", "cam", "x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, person int, cam int, x array<double>").parquet(str(tmp_path / "in"))
    seen = []
    q = rank_stream.rank_stream(stream, s.where("not is_query"), lambda df, e: seen.append(df.groupBy("probe_id").count().count()), 3).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sum(seen) == 12


def test_splits(spark):
    s, _ = labelled(spark, 20)
    held = spark.createDataFrame([(0, 3), (0, 4), (1, 5)], "trial int, idx long")
    train, test = pipeline.split_trial(s, held, 0)
    assert train.count() == 18 and sorted(r["id"] for r in test.collect()) == [3, 4]


@pytest.mark.parametrize("name", ["kissme", "mahal", "l2", "xqda", "itml", "lmnn", "ldml"])
def test_learners_behind_one_interface(spark, name):
    s, _ = labelled(spark, 60, 3, 3)
    p = pairs.positives(s).select("id_a", "id_b", "x_a", "x_b", F.lit(True).alias("match")).unionByName(pairs.negatives(s).select("id_a", "id_b", "x_a", "x_b", F.lit(False).alias("match")))
    make = {"itml": lambda: protocol.Itml(max_constraints=60), "lmnn": lambda: protocol.Lmnn(2, 2), "ldml": lambda: protocol.Ldml(steps=2)}.get(name, protocol.LEARNERS[name])
    for metric in (make().fit_pairs(p), make().fit_labels(s)):
        assert metric.m.shape == (3, 3) and metric.m == pytest.approx(metric.m.T, abs=1e-7)
        assert len(s.select(metric.project(F.col("x")).alias("y")).first()["y"]) == 3


def test_iris_like_accuracy(spark):
    s, _ = labelled(spark, 150, 4, 3)
    gamma, table = protocol.tune_itml(s, powers=(0,), max_constraints=240)
    assert gamma == 1.0 and table.first()["accuracy"] > 0.7


def test_pruned_assignment_equals_the_plain_one(spark):
    x = np.random.default_rng(4).normal(size=(300, 3))
    c = x[:12]
    key = lambda r: (r["id"], r["cluster"], round(r["d"], 9))
    assert sorted(map(key, kmeans.assign(points(spark, x), c).collect())) == sorted(map(key, kmeans.assign_pruned(points(spark, x), c).collect()))


def test_training_application(spark, tmp_path):
    p = raster(spark, images_=8)
    people = spark.createDataFrame([(i, i // 2 % 3, i % 2) for i in range(8)], "image_id long, person int, cam int")
    s = pipeline.Settings(width=16, height=16, patch=4, words=3, top=2, strip=8, step=8, radii=(1, 2), segment="patch", types=("HOG",), parts=True)
    algorithm = pipeline.train_application(p, people, s, str(tmp_path / "out"), "mahal")
    assert spark.read.parquet(str(tmp_path / "out/metric")).count() == 81 and spark.read.parquet(str(tmp_path / "out/codebook")).count() == 3
    assert all(len(r["x"]) == 15 for r in algorithm.test(p).collect())
    table, sp = algorithm.features(p)
    from matchlight.operators import strips as st

    a = pipeline.aligned_pairs(table, st.strips(sp, 16, 8, 8), people, "HOG")
    m = cov.to_matrix(a, mean=False)
    assert m.shape == (9, 9) and m == pytest.approx(m.T) and np.linalg.eigvalsh(m).min() > -1e-6


def drawn_points(spark, n=90, seed=3, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 5)), i % 2, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, person int, cam int, x array<double>")


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("blocks", [8, 0])
def test_comparisons_equal_brute_force_in_both_ways(spark, monkeypatch, blocks):
    """Probes that go along with the tasks, and probes that are dealt in blocks."""
    rows, s = drawn_points(spark)
    monkeypatch.setattr(score, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(score, "BLOCK", 40)
    monkeypatch.setattr(score, "PART", 25)
    monkeypatch.setattr(score, "CELLS", 400)
    s = s.repartition(3)
    x = {r[0]: np.array(r[3]) for r in rows}
    person = {r[0]: r[1] for r in rows}
    d = {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in x for j in x}

    def best(i, k, among):
        return sorted((d[i, j], j) for j in among)[:k]

    got = {(r["probe_id"], r["gallery_id"]): r["score"] for r in score.score(s, s, vec.squared_distance).collect()}
    assert got.keys() == d.keys() and all(abs(got[p] - d[p]) < 1e-9 for p in d)
    want = {(i, j, k + 1) for i in x for k, (_, j) in enumerate(best(i, 3, [j for j in x if j != i]))}
    assert {(r["test"], r["train"], r["rk"]) for r in knn.neighbours(s, s, 3, skip_self=True).collect()} == want
    targets = {i: best(i, 2, [j for j in x if j != i and person[j] == person[i]]) for i in x}
    assert {(r["i"], r["j"], r["rk"]) for r in knn.target_neighbours(s, 2).collect()} == {(i, j, k + 1) for i in x for k, (_, j) in enumerate(targets[i])}
    near = {(i, j, k + 1) for i in x for k, (_, j) in enumerate(best(i, 2, [j for j in x if person[j] != person[i]]))}
    assert {(r["i"], r["l"], r["rk"]) for r in knn.nearest_impostors(s, 2).collect()} == near
    margin = {i: max(t)[0] + 0.5 for i, t in targets.items()}
    inside = {(i, j) for i in x for j in x if person[i] != person[j] and d[i, j] < max(margin[i], margin[j])}
    assert {(r["i"], r["l"]) for r in knn.impostors(s, knn.margins(s, 2, 0.5)).collect()} == inside
    energy = {}
    for i in x:
        of = {}
        for label in set(person.values()):
            own = best(i, 2, [j for j in x if person[j] == label])
            limit = own[-1][0] + 1
            of[label] = sum(v for v, _ in own) + sum(max(limit - d[i, j], 0) for j in x if person[j] != label)
        energy[i] = min(of, key=lambda label: (round(of[label], 9), label))
    assert {r["test"]: r["label"] for r in knn.energy_classify(s, s, 2).collect()} == energy
    fused = {(r["probe_id"], r["gallery_id"]): r["score"] for r in score.score(s, s, score.fused(2), ("id",)).collect()}
    assert all(abs(v - (abs(x[i][:3] @ x[j][:3]) * abs(x[i][3:] @ x[j][3:])) ** 0.5) < 1e-9 for (i, j), v in fused.items()) and len(fused) == 8100
    assert knn.neighbours(s.limit(0), s, 3).count() == knn.neighbours(s, s.limit(0), 3).count() == 0


def test_drawn_negatives_are_distinct_and_as_many_as_positives(spark):
    rows, s = drawn_points(spark, 300)
    got = [(r["id_a"], r["id_b"], r["match"]) for r in pairs.balanced(s).collect()]
    neg = [p[:2] for p in got if not p[2]]
    info = {r[0]: r[1:3] for r in rows}
    assert 2 * len(neg) == len(got) and len(set(neg)) == len(neg)
    assert all(a < b and info[a][0] != info[b][0] and info[a][1] != info[b][1] for a, b in neg)
    there = sum(info[a][0] != info[b][0] and info[a][1] != info[b][1] for a in info for b in info if a < b)
    assert pairs.negatives_there(s) == there
    few = spark.createDataFrame([(0, 1, 0, [0.0]), (1, 1, 1, [0.0]), (2, 1, 1, [0.0]), (3, 2, 1, [0.0])], "id long, person int, cam int, x array<double>")
    assert found(pairs.balanced(few).select("id_a", "id_b", "match")) == [(0, 1, True), (0, 2, True), (0, 3, False)]
    draws = spark.range(20_000).select(pairs.draw(F.col("id"), F.lit(1), F.lit(500)).alias("a"), pairs.draw(F.col("id"), F.lit(2), F.lit(500)).alias("b"))
    assert draws.distinct().count() > 18_500


def test_learners_equal_numpy(spark):
    rows, s = drawn_points(spark, 80)
    p = [(a, b) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and a[0] < b[0]]
    q = [(a, b) for a in rows for b in rows if a[1] != b[1] and a[2] != b[2] and a[0] < b[0]]
    diff = lambda v: np.array([np.array(a[3]) - np.array(b[3]) for a, b in v])
    table = spark.createDataFrame([(a[3], b[3], m) for v, m in ((p, True), (q, False)) for a, b in v], "x_a array<double>, x_b array<double>, match boolean").repartition(3)
    pos, neg = learners.pair_covariances(table)
    sp, sq = diff(p).T @ diff(p) / len(p), diff(q).T @ diff(q) / len(q)
    assert np.allclose(pos, sp) and np.allclose(neg, sq)
    m = np.linalg.inv(sp) - np.linalg.inv(sq)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    want = m if values.min() > 0 else (vectors * np.where(values < dense.ZERO, dense.EPS, values)) @ vectors.T
    assert np.allclose(learners.kissme(pos, neg), want) and np.allclose(learners.mahalanobis(pos) @ sp, np.eye(6))


def test_large_margin_loss_and_gradient(spark):
    rows, s = drawn_points(spark, 60)
    x = np.array([r[3] for r in rows])
    y = np.array([r[1] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    targets = {i: [j for _, j in sorted((d[i, j], j) for j in range(60) if j != i and y[j] == y[i])[:2]] for i in range(60)}

    def loss(l):
        z = x @ l.T
        e = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        pull = sum(e[i, j] for i in targets for j in targets[i])
        push = sum(max(0.0, 1 + e[i, j] - e[i, k]) for i in targets for j in targets[i] for k in range(60) if y[k] != y[i])
        return 0.5 * pull + 0.5 * push

    l, told = learners.lmnn(s, 2, steps=12)
    assert abs(told[0] - loss(np.eye(6))) < 1e-6 * told[0] and abs(told[-1] - loss(l)) < 1e-6 * told[-1]
    assert all(b <= a for a, b in zip(told, told[1:])) and told[-1] < told[0]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from matchlight.scratch import ensure_checkpoint_dir

    def session(master, folder, made):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: {"spark.checkpoint.dir": folder}, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=sc)

    made = []
    ensure_checkpoint_dir(session("yarn", "hdfs://a/b", made))
    assert made == ["hdfs://a/b"]
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077", None, made))
    ensure_checkpoint_dir(session("local[4]", None, made))
    assert len(made) == 2


@pytest.mark.parametrize("h, w, n, compactness, seed", [(24, 30, 12, 20.0, 1), (17, 11, 5, 1.0, 2), (40, 12, 30, 40.0, 3), (9, 9, 1, 10.0, 4), (6, 5, 40, 5.0, 5)])
def test_clustering_equals_a_loop_over_pixels(h, w, n, compactness, seed):
    """Every pixel looks at every centre whose window holds it; pieces are found by union of equal neighbours."""
    rng = np.random.default_rng(seed)
    rgb = np.kron(rng.integers(0, 256, (h // 3 + 1, w // 3 + 1, 3)), np.ones((3, 3, 1)))[:h, :w] + rng.integers(0, 9, (h, w, 3))
    rgb = np.minimum(rgb, 255)
    lab = superpixel._lab(rgb)
    step, at = superpixel.seed_grid(w, h, n)
    centres = [[*lab[y, x], float(x), float(y)] for x, y in at]
    label = {(y, x): -1 for y in range(h) for x in range(w)}
    for _ in range(10):
        for y, x in label:
            seen = []
            for k, c in enumerate(centres):
                if max(int(c[3] - step), 0) <= x < min(int(c[3] + step), w) and max(int(c[4] - step), 0) <= y < min(int(c[4] + step), h):
                    place = (x - c[3]) ** 2 + (y - c[4]) ** 2
                    seen.append((round(sum((lab[y, x, j] - c[j]) ** 2 for j in range(3)) + place * (compactness / step) ** 2, 9), k))
            if seen:
                label[y, x] = min(seen)[1]
        for k in range(len(centres)):
            own = [p for p in label if label[p] == k]
            centres[k] = [sum(v) / len(own) for v in zip(*((*lab[p], p[1], p[0]) for p in own))] if own else [0.0] * 5
    group = {p: p for p in label}

    def top(p):
        while group[p] != p:
            p = group[p]
        return p

    for y, x in label:
        for q in ((y, x + 1), (y + 1, x)):
            if q in label and label[q] == label[y, x]:
                a, b = sorted((top((y, x)), top(q)))
                group[b] = a
    pieces = {}
    for p in sorted(label):
        pieces.setdefault(top(p), []).append(p)
    want, last, number = {}, 0, 0
    for first in sorted(pieces):
        for q in ((first[0], first[1] - 1), (first[0] - 1, first[1]), (first[0], first[1] + 1), (first[0] + 1, first[1])):
            last = want.get(q, last)
        small = len(pieces[first]) <= (h * w // n) >> 2
        want |= dict.fromkeys(pieces[first], last if small else number)
        number += not small
    got = superpixel.cluster(rgb, n, compactness)
    assert {p: int(got[p]) for p in label} == want


def test_the_array_sink_refuses_tables(spark, tmp_path):
    cells = spark.range(50).selectExpr("'a' AS name", "cast(id AS int) AS row", "0 AS col", "0.5D AS value")
    with pytest.raises(Exception, match="maxCells"):
        spark.dataSource.register(mat5.Mat5DataSource)
        cells.write.format("mat5").option("path", str(tmp_path / "x.mat")).option("maxCells", 20).mode("append").save()
    assert not (tmp_path / "x.mat").exists()


@pytest.mark.parametrize("strategy", ["farthest_point", "largest_variance"])
def test_kept_bounds_equal_plain_rounds(spark, strategy):
    x = np.random.default_rng(8).normal(size=(400, 4))
    s = points(spark, x).repartition(3)
    for turns in (1, 4, -1):
        assert np.allclose(kmeans.fit_bounds(s, 9, turns, strategy, centres=x[:9]), kmeans.fit(s, 9, turns, strategy, centres=x[:9]))
    far = np.vstack([x[:3], np.full(4, 90.0)])  # one centre loses all rows
    assert np.allclose(kmeans.fit_bounds(s, 4, -1, strategy, centres=far), kmeans.fit(s, 4, -1, strategy, centres=far))


def test_bags_of_one_are_pairs_and_the_nearest_members_count(spark):
    r = np.random.default_rng(3)
    rows = [(bool(i % 2), r.normal(size=(1 + i % 3, 2)).tolist(), r.normal(size=(1 + i % 2, 2)).tolist()) for i in range(40)]
    bags = spark.createDataFrame([*rows, (True, [], [[1.0, 2.0]])], "match boolean, bag_a array<array<double>>, bag_b array<array<double>>").repartition(3)
    told = learners.mildml(bags, 2, np.eye(2), steps=5)[2]
    want = 0.0
    for match, a, b in rows:
        z = min(float(((np.array(u) - np.array(v)) ** 2).sum()) for u in a for v in b) - 1
        want += np.logaddexp(0, z if match else -z) / 20
    assert abs(told[0] - want) < 1e-9 and told == sorted(told, reverse=True) and told[-1] < told[0]
    pairs_ = spark.createDataFrame([(m, a[0], b[0]) for m, a, b in rows], "match boolean, x_a array<double>, x_b array<double>")
    ones = pairs_.select("match", F.array("x_a").alias("bag_a"), F.array("x_b").alias("bag_b"))
    assert np.allclose(learners.ldml(pairs_, 2, np.eye(2), steps=3)[0], learners.mildml(ones, 2, np.eye(2), steps=3)[0])


def test_line_search_on_a_curved_valley():
    def f(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, told = learners.conjugate_gradient(f, np.array([-1.2, 1.0]), 400)
    assert x == pytest.approx([1, 1], abs=1e-2) and all(b <= a for a, b in zip(told, told[1:]))


def test_vectors_longer_than_rows_are_learned_in_their_span(spark):
    r = np.random.default_rng(5)
    low = r.normal(size=(24, 4)) + np.repeat(r.normal(size=(6, 4)) * 3, 4, axis=0)
    turn = np.linalg.qr(r.normal(size=(60, 4)))[0]
    table = lambda x: spark.createDataFrame([(i, i // 4, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, person int, cam int, x array<double>")
    w, m = learners.xqda(table(low @ turn.T))
    assert w.shape[0] == 60 and len(m) == w.shape[1]
    v, n = learners.xqda(table(low))
    gap = lambda a, b, x, w, m: (x[a] - x[b]) @ w @ m @ w.T @ (x[a] - x[b])
    for a, b in ((0, 5), (3, 20), (7, 8)):
        assert gap(a, b, low @ turn.T, w, m) == pytest.approx(gap(a, b, low, v, n), rel=1e-6)


def test_colour_names_from_a_file(spark, tmp_path):
    w2c = np.random.default_rng(1).random((32**3, 11))
    (tmp_path / "w2c.mat").write_bytes(mat5.dumps({"w2c": w2c}))
    table = images.colour_names(spark, str(tmp_path / "w2c.mat"))
    row = table.where("idx = 4321").first()
    assert table.count() == 32**3 and row["p"] == pytest.approx(w2c[4321])
    sp = spark.createDataFrame([(1, 0, 0, 0, 8, 16, 24)], "image_id int, sp int, row int, col int, red int, green int, blue int")
    got = features.table(sp, types=("CN",), colours=table).first()["feat"]
    assert got == pytest.approx(np.sqrt(w2c[1 + 32 * 2 + 1024 * 3]))


def test_own_feature_types_and_pooling(spark, monkeypatch):
    monkeypatch.setattr(features, "REGISTRY", dict(features.REGISTRY))
    monkeypatch.setattr(features, "SIZES", dict(features.SIZES))
    features.register("MEAN_RED", 2, lambda x: x.groupBy("image_id", "sp").agg(F.avg("red").alias("v")).select("image_id", "sp", F.lit(1).alias("bin"), "v"))
    sp = spark.createDataFrame([(1, 0, 10), (1, 0, 20)], "image_id int, sp int, red int")
    assert features.table(sp, types=("MEAN_RED",)).first()["feat"] == [0.0, 15.0]
    v = spark.createDataFrame([(1, "HOG", 0, 3, 0.0, 1)], "image_id int, type string, sp int, word int, distance double, rank int")
    bands = spark.createDataFrame([(1, 0, 0, "low"), (1, 0, 0, "mid")], "image_id int, sp int, strip int, band string")
    got = bow.strip_histograms(v, bands, pooling=lambda *c: sum(c[1:], c[0]) * 5).first()["h"]
    assert got == pytest.approx(10.0)


@pytest.mark.parametrize("blocks", [0, 8])
def test_counted_curves_are_those_of_sorted_scores(spark, monkeypatch, blocks):
    """Ties by copies, both directions; no pair leaves its block."""
    monkeypatch.setattr(score, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(score, "BLOCK", 2)
    monkeypatch.setattr(score, "PART", 5)
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (60, 4)).astype(float)
    rows = [(t, i, x[(i * 7 + 30 * side) % 60].tolist(), side) for t in (0, 1) for i in range(25) for side in (0, 1)]
    both = spark.createDataFrame(rows, "trial int, id long, x array<double>, side int")
    a, b = (both.where(f"side = {k}").drop("side") for k in (0, 1))
    pairs = a.selectExpr("trial", "id probe", "x a").join(b.selectExpr("trial", "id gallery", "x b"), "trial").withColumn("match", F.col("probe") == F.col("gallery"))
    for measure, largest, ties, whole in ((vec.dot, True, False, evaluate.symmetric_cmc), (vec.squared_distance, False, True, evaluate.euclid_cmc)):
        want = whole(pairs.withColumn("score", measure(F.col("a"), F.col("b"))), 20).orderBy("rank").collect()
        assert evaluate.sides_curve(a, b, measure, 20, largest, ties).orderBy("rank").collect() == want
    s = spark.createDataFrame([(i, i % 4, x[i].tolist()) for i in range(60)], "id long, person int, x array<double>")
    p, g = s.where("id % 10 = 0"), s.where("id % 10 <> 0")
    scores = p.selectExpr("id probe", "person pp", "x a").crossJoin(g.selectExpr("id gallery", "person gp", "x b"))
    scores = scores.select("probe", "gallery", (F.col("pp") == F.col("gp")).alias("match"), vec.dot(F.col("a"), F.col("b")).alias("score"))
    assert evaluate.closed_set_curve(p, g, 20).orderBy("rank").collect() == evaluate.closed_set_cmc(scores, 20).orderBy("rank").collect()
    with pytest.raises(ValueError):
        evaluate.closed_set_curve(p, g.where("person <> 0"), 20)


def test_packed_draws_are_the_joined_ones(spark, monkeypatch):
    from matchlight.operators import draws

    r = np.random.default_rng(4)
    s = spark.createDataFrame([(3 * i, int(r.integers(0, 4)) if i % 11 else None, int(r.integers(0, 2)), r.normal(size=5).tolist()) for i in range(90)], "id long, person int, cam int, x array<double>")
    told = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(draws, "CHUNK", 1000)
    monkeypatch.setattr(draws, "BUCKET", 100)
    monkeypatch.setattr(draws, "ROWS", 64)
    positive_pairs = []
    monkeypatch.setattr(pairs, "positives", lambda *a, f=pairs.positives: positive_pairs.append(1) or f(*a))
    packed = told(pairs.balanced(s))
    assert not positive_pairs  # no pair was joined
    monkeypatch.setattr(draws, "HELD_ROWS", 0)
    assert packed == told(pairs.balanced(s)) and positive_pairs and len(packed) > 500
    assert draws.unpack(draws.pack(np.array([0, 255, 256, 1 << 40])), 4).tolist() == [0, 255, 256, 1 << 40]


def test_crossing_sorts_few_rows_and_agrees(spark):
    """Ties of distances between matches and others, far and near the crossing; folds that have only one kind."""
    r = np.random.default_rng(6)
    rows = [(k, bool(r.random() < 0.5), float(r.integers(0, 30)) / 8, k % 3 if k < 590 else 3) for k in range(600)]
    rows += [(1000 + k, k < 3, 1.0 + k * 1e-12, 4) for k in range(6)]
    x = spark.createDataFrame(rows, "key long, match boolean, distance double, fold int")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(evaluate.crossing(x, "fold")) == told(evaluate.equal_error(evaluate.accumulated(x, "fold"), "fold"))
    assert told(evaluate.crossing(x)) == told(evaluate.equal_error(evaluate.roc(x)))


def test_positives_in_blocks_give_the_likelihood_of_made_pairs(spark, monkeypatch):
    """Nulls, three cameras and blocks of unequal sides; no positive pair is made, but where ids are repeated."""
    from matchlight.operators import held

    r = np.random.default_rng(8)
    rows = [(i, None if i == 7 else i % 3, None if i == 8 else int(r.integers(0, 3)), r.normal(size=4).tolist()) for i in range(150)]
    s = spark.createDataFrame(rows, "id long, person int, cam int, x array<double>").repartition(3)
    monkeypatch.setattr(held, "SIDE", 7)
    made = pairs.positives(s).selectExpr("true match", "x_a", "x_b").unionByName(pairs.negatives(s).selectExpr("false match", "x_a", "x_b"))
    want = learners.ldml(made, 4, np.eye(4)[:3], steps=4)
    assert held.LabelledPairs.of(s.unionByName(s.where("id = 5")), pairs.negatives(s)) is None
    monkeypatch.setattr(pairs, "positives", None)
    got = learners.ldml_labels(s, 4, np.eye(4)[:3], steps=4)
    assert np.allclose(got[0], want[0]) and np.allclose(got[2], want[2]) and abs(got[1] - want[1]) < 1e-9


def test_types_fused_in_blocks_are_the_fused_tables(spark, monkeypatch):
    """A type may lack an id; a pair without a common type is left out."""
    r = np.random.default_rng(9)
    tables = [spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(40) if (i + k) % 5], "id long, x array<double>") for k in range(4)]
    tables[0] = tables[0].unionByName(spark.createDataFrame([(100, [1.0, 2.0, 3.0])], "id long, x array<double>"))
    tables[1] = tables[1].unionByName(spark.createDataFrame([(101, [1.0, 2.0, 3.0])], "id long, x array<double>"))
    halves = lambda low: [t.where(f"(id % 2 = 0) = {low}") for t in tables]
    rows = None
    for k, (p, g) in enumerate(zip(halves("true"), halves("false"))):
        x = score.score(p, g, vec.dot, ("id",)).selectExpr("probe_id probe", "gallery_id gallery", f"{k} type", "abs(score) score")
        rows = x if rows is None else rows.unionByName(x)
    told = lambda df: {(a, b): v for a, b, v in df.collect()}
    want = told(score.fuse(rows))
    monkeypatch.setattr(score, "fuse", None)
    got = told(score.fuse_types(halves("true"), halves("false")))
    assert got.keys() == want.keys() and (100, 101) not in got and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def two_classes(spark, n=300):
    """Vectors of few values, so that many distances are equal."""
    rows = [(i, i % 3, i % 2, [float((i * 7 + j * 5) % 4) for j in range(6)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, person int, cam int, x array<double>")


def test_balanced_pairs_of_the_tasks_are_those_of_the_joins(spark, monkeypatch):
    from matchlight.operators import balance, draws

    s = two_classes(spark)
    monkeypatch.setattr(draws, "BUCKET", 500)
    told = draws.distances(pairs.balanced(s), s).collect()
    want = sorted((r["id_a"] * balance.KEY + r["id_b"], r["match"], r["distance"]) for r in told)
    packed = balance.Balanced.of(s, 5)
    assert sorted((r["key"], r["match"], r["distance"]) for r in packed.rows().collect()) == want and len(want) > 10_000
    assert sum(r["sp"] + r["sq"] for r in packed.sums().collect()) == len(want)
    assert balance.Balanced.of(s.unionByName(s.where("id = 5"))) is None


def test_errors_and_curve_of_packed_pairs(spark, monkeypatch):
    from matchlight.operators import balance

    s = two_classes(spark)
    monkeypatch.setattr(balance, "RANGE", 1500)
    monkeypatch.setattr(balance, "BITS", 12)
    folded, packed = balance.Balanced.of(s, 5), balance.Balanced.of(s)
    rows = folded.rows().drop("__part").cache()
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(evaluate.fold_errors(folded)) == told(evaluate.fold_errors(rows))
    assert told(evaluate.crossing(packed)) == told(evaluate.crossing(rows.drop("fold")))
    want = told(evaluate.roc(rows.drop("fold")))
    assert told(evaluate.roc(packed)) == want
    monkeypatch.setattr(balance, "RANGE", 1)
    assert packed.roc() is None and told(evaluate.roc(packed)) == want


def test_draws_are_sent_as_gaps(spark, monkeypatch):
    """A drawn pair takes no more than three bytes; with its code it took more."""
    from matchlight.operators import draws

    s = two_classes(spark)
    h = draws.Held(s)
    first, _ = draws.chosen(s, h, spark.sparkContext.broadcast(h), pairs.negatives_there(s))
    r = first.select("n", *[c for t, c in (("draws", "draws"), ("codes", "codes")) if c in first.columns]).collect()
    assert sum(len(v) for x in r for v in x[1:]) <= 3 * sum(x["n"] for x in r)


def test_many_probes_go_along_and_keep_their_nearest(spark, monkeypatch):
    """Vectors with ties; the exact scores and ids are those of a sort of all pairs, and no side is shuffled to the other."""
    s = two_classes(spark, 200)
    rows = s.collect()
    want = []
    for a in rows:
        near = sorted((sum((u - v) ** 2 for u, v in zip(a["x"], b["x"])), b["id"]) for b in rows if b["person"] == a["person"] and b["id"] != a["id"])[:3]
        want += [(a["id"], i, d, k + 1) for k, (d, i) in enumerate(near)]
    monkeypatch.setattr(score, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(score, "CHUNK", 64)
    monkeypatch.setattr(score, "CELLS", 64 * 64 * 16)
    assert score.Probes(s, ("id", "person")).held is not None
    assert sorted(map(tuple, knn.target_neighbours(s, 3).collect())) == sorted(want)
    assert knn.neighbours(s, s, 4).count() == 800


def test_lmnn_of_repeated_ids_is_that_of_target_ids(spark):
    from matchlight.operators import held as along

    s = two_classes(spark, 60)
    plain = learners.lmnn(s, 2, steps=3)[1]
    keep, along.gathered = along.gathered, lambda *_: None
    try:
        assert np.allclose(learners.lmnn(s, 2, steps=3)[1], plain)
    finally:
        along.gathered = keep


@pytest.mark.parametrize("learner", [learners.kissme, lambda pos, neg: learners.mahalanobis(pos), lambda pos, neg: pos - neg])
def test_folds_without_stored_pairs(spark, monkeypatch, learner):
    s, rows = labelled(spark, 240)
    rows = [(2 * i if i < 100 else 3 * i, p, None if i % 50 == 7 else c, x) for i, p, c, _, x in rows] + [(1001, 2, 1, rows[2][4]), (1003, 2, 1, rows[2][4])]
    s = spark.createDataFrame(rows, "id long, person int, cam int, x array<double>")
    monkeypatch.setattr(folds.held, "SIDE", 8)
    monkeypatch.setattr(folds, "OTHERS", 100)
    p = pairs.positives(s).select("id_a", "id_b", "x_a", "x_b", F.lit(True).alias("match")).unionByName(pairs.negatives(s).select("id_a", "id_b", "x_a", "x_b", F.lit(False).alias("match")))
    p = p.withColumns({"fold": (F.col("id_a") % 2).cast("int"), "key": F.col("id_a") * 100_000 + F.col("id_b")})
    told = pipeline.cross_validate(p, learner, [0, 1])
    packed = folds.Folded.of(s, learner, 2)
    every = spark.createDataFrame([(f, b) for f in (0, 1) for b in range(folds.balance.BINS)], "fold int, __part long")
    want, got = (sorted((r["fold"], r["key"], r["match"], r["distance"]) for r in df.collect()) for df in (told, packed.rows(every)))
    assert [w[:3] for w in want] == [g[:3] for g in got] and np.allclose([w[3] for w in want], [g[3] for g in got])
    assert sum(r["sp"] + r["sq"] for r in packed.sums().collect()) == len(want)
    want, got = ({r["fold"]: r["eer"] for r in evaluate.fold_errors(x).collect()} for x in (told, packed))
    assert want == pytest.approx(got)


def test_folds_of_repeated_ids_and_small_classes_go_by_pairs(spark):
    s, rows = labelled(spark)
    assert folds.Folded.of(s.unionByName(s.limit(1)), learners.kissme, 2) is None
    assert folds.Folded.of(s.withColumn("person", F.col("id").cast("int")), learners.kissme, 2) is None


@pytest.mark.parametrize("order", ["best_first", "worst_first"])
def test_precision_without_stored_scores(spark, monkeypatch, order):
    monkeypatch.setattr(evaluate, "ROWS", 7)
    _, rows = labelled(spark)
    rows = [(i, -1 if i % 11 == 3 else p, c, i % 5 == 0, [float(round(v)) for v in x]) for i, p, c, _, x in rows]  # ties, junk
    rows += [(200, 9, 0, True, rows[0][4]), (201, 8, 0, True, rows[1][4]), (202, 8, 0, False, rows[1][4])]
    s = spark.createDataFrame(rows, "id long, person int, cam int, is_query boolean, x array<double>")
    p, g = s.where("is_query"), s.where("not is_query")
    for a, b in ((p, g), (p, g.where("person = -1")), (p.limit(0), g), (p.unionByName(p.limit(1)).where("id > 0"), g), (p, g.withColumn("cam", F.when(F.col("id") > 9, F.col("cam"))))):
        want = {r["probe_id"]: r for r in evaluate.average_precision(score.score(a, b, vec.euclidean), order).collect()}
        got = {r["probe_id"]: r for r in evaluate.precision(a, b, vec.euclidean, order).collect()}
        assert want.keys() == got.keys()
        assert all((want[k]["first_hit"], want[k]["n_good"]) == (got[k]["first_hit"], got[k]["n_good"]) and want[k]["ap"] == pytest.approx(got[k]["ap"]) for k in want)
    plan = evaluate.precision(p, g, vec.euclidean, order)._jdf.queryExecution().toString()
    assert "Window" not in plan
