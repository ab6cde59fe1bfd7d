"""The applications: from pixels to descriptors, training of codebooks and metrics, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..metric import learners
from ..metric.dense import factor
from ..operators import bow, evaluate, features, kmeans, knn, pairs, pca, score, strips, superpixel
from ..scratch import cut


@dataclass
class Settings:
    """Sizes of the bag of words; defaults for images of 128 by 48, enlarged four times."""

    width: int = 192
    height: int = 512
    superpixels: int = 500
    compactness: float = 20.0
    patch: int = 16
    words: int = 350
    top: int = 10
    sigma: float = 3.0
    strip: int = 32
    step: int = 32
    shift: int = 0
    radii: tuple[int, int] = (12, 20)
    weight: str = "soft"
    types: tuple[str, ...] = ("HSV", "CN", "HOG", "SILTP")
    word_level: bool = False
    segment: str = "slic"
    parts: bool = False
    pooling: str | Callable = "mean"
    colours: DataFrame | None = None
    segmenters: dict[str, Callable] = field(default_factory=dict)


class BagOfWords:
    """train(pixels) fits codebooks; test(pixels) gives descriptors."""

    def __init__(self, settings: Settings, codebook: DataFrame | None = None):
        self.settings, self.codebook = settings, codebook

    def segment(self, pixels: DataFrame) -> DataFrame:
        s = self.settings
        if s.segment in s.segmenters:
            return s.segmenters[s.segment](pixels)
        if s.segment == "patch":
            return superpixel.patches(pixels, s.patch, s.width)
        labels = superpixel.slic(pixels, s.superpixels, s.compactness).drop("mask")
        return pixels.join(labels, ["image_id", "row", "col"])

    def features(self, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Features of all foreground superpixels, and the superpixels."""
        sp = cut(self.segment(pixels))
        sp = sp.join(superpixel.foreground(sp), ["image_id", "sp"], "left_semi")
        table = features.table(sp, self.settings.radii, self.settings.types, self.settings.colours)
        return (table.unionByName(features.fused(table)) if self.settings.word_level else table), sp

    def train(self, pixels: DataFrame, metrics: dict | None = None) -> DataFrame:
        """Codebooks by type; under a metric distances are those of the projected features."""
        table, _ = self.features(pixels)
        table = cut(table)
        out = None
        for t in self.settings.types + (("ALL",) if self.settings.word_level else ()):
            rows = table.where(F.col("type") == t).select((F.col("image_id") * 10_000 + F.col("sp")).alias("id"), F.col("feat").alias("x"))
            scale = factor(metrics[t]) if metrics and t in metrics else None
            centres = kmeans.fit(rows, self.settings.words, 100, "farthest_point", scale)
            part = kmeans.codebook(rows, t, centres)
            out = part if out is None else out.unionByName(part)
        self.codebook = out
        return out

    def histograms(self, pixels: DataFrame) -> DataFrame:
        s = self.settings
        table, sp = self.features(pixels)
        v = cut(bow.votes(table, self.codebook, s.top))
        if s.parts:
            bands = strips.body_strips(sp)
        else:
            bands = strips.bands(sp, s.height, s.strip, s.step, s.shift) if s.shift else strips.strips(sp, s.height, s.strip, s.step)
        return bow.strip_histograms(v, bands, s.weight, s.pooling)

    def test(self, pixels: DataFrame) -> DataFrame:
        """image_id, x: one dense descriptor an image."""
        s = self.settings
        n_strips = len(strips.BODY_PARTS) if s.parts else (s.height - s.strip) // s.step + 1
        order = ("ALL",) if s.word_level else s.types
        return bow.dense_descriptor(self.histograms(pixels), order, n_strips, s.words)


def train_metric(samples: DataFrame, learner: str = "kissme", draws: int = 5, dims: int | None = None):
    """M from samples(id, person, cam, x): positives under both cameras and drawn negatives; vectors reduced to dims components first."""
    if dims:
        mean, rows, _ = pca.fit(samples, F.col("x"))
        samples = cut(samples.withColumn("x", pca.transform(samples, F.col("x"), mean, rows, dims)))
    pos, neg = learners.sample_covariances(samples, draws)
    return samples, covariance_learner(learner, pos, neg)


def evaluate_metric(samples: DataFrame, m, max_rank: int = 20) -> tuple[DataFrame, DataFrame]:
    """Mean average precision and match curve of distances under M: queries against all other rows."""
    moved = cut(samples.withColumn("x", vec.matvec(vec.matrix(factor(m)), F.col("x"))))
    ap = cut(evaluate.precision(moved.where("is_query"), moved.where("not is_query"), vec.euclidean, "worst_first"))
    return evaluate.mean_precision(ap), evaluate.precision_curve(ap, max_rank)


def cross_validate(pairs_: DataFrame, learner: Callable, folds: list[int]) -> DataFrame:
    """fold, key, distance, match: each fold scored under the metric of the others."""
    out = None
    for f in folds:
        pos, neg = learners.pair_covariances(pairs_.where(F.col("fold") != f))
        part = score.pair_distances(pairs_.where(F.col("fold") == f), learner(pos, neg), ("fold", "key", "match")).select("fold", "key", "distance", "match")
        out = part if out is None else out.unionByName(part)
    return out


def split_trial(samples: DataFrame, splits: DataFrame, trial: int) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and to test with in a trial: rows of the split are the test."""
    held = splits.where(F.col("trial") == trial).select(F.col("idx").alias("id"))
    return samples.join(held, "id", "left_anti"), samples.join(held, "id", "left_semi")


def train_application(pixels: DataFrame, people: DataFrame, settings: Settings, folder: str, learner: str = "kissme") -> BagOfWords:
    """Metrics by type, then codebooks under them; each is written to the folder as soon as it is there, so a failure later loses none before.

    people(image_id, person, cam): superpixels in one strip make the pairs, of one person under both cameras against all others.
    """
    algorithm = BagOfWords(settings)
    table, sp = algorithm.features(pixels)
    table = cut(table)
    places = strips.strips(sp, settings.height, settings.strip, settings.step)
    metrics = {}
    for t in settings.types:
        m = metrics[t] = aligned_metric(table, places, people, t, learner)
        rows = [(t, i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
        pixels.sparkSession.createDataFrame(rows, "type string, i int, j int, v double").write.mode("append").parquet(f"{folder}/metric")
    algorithm.train(pixels, metrics).write.mode("overwrite").parquet(f"{folder}/codebook")
    return algorithm


def aligned_metric(features_: DataFrame, strip_table: DataFrame, people: DataFrame, type_: str, learner: str = "kissme"):
    """M of one feature type from superpixels in equal strips: pairs of one person, and all others by the difference of sums."""
    from ..operators import cov

    same, every = cut(aligned_pairs(features_, strip_table, people, type_)), cut(aligned_pairs(features_, strip_table, people, type_, "strip"))
    n_same, n_all = same.first()["n"], every.first()["n"]
    pos, whole = cov.to_matrix(same, mean=False), cov.to_matrix(every, mean=False)
    return covariance_learner(learner, pos / max(n_same, 1), (whole - pos) / max(n_all - n_same, 1))


def covariance_learner(learner: str, pos, neg):
    return {"kissme": lambda: learners.kissme(pos, neg), "mahal": lambda: learners.mahalanobis(pos), "xqda": lambda: learners.xqda_histograms(pos, neg), "l2": lambda: learners.euclidean(len(pos))}[learner]()


def aligned_pairs(features_: DataFrame, strip_table: DataFrame, people: DataFrame, type_: str, by: str = "person") -> DataFrame:
    """i, j, v, n: scatter of superpixel differences inside equal strips over all pairs of images under both cameras, of one person or (by="strip") of any, by sums of strips and without the pairs."""
    from ..operators import cov

    x = strip_table.where("band = 'mid'").join(features_.where(F.col("type") == type_), ["image_id", "sp"]).join(people, "image_id")
    key = F.concat_ws(":", F.col("person").cast("string"), F.col("strip").cast("string")) if by == "person" else F.col("strip").cast("string")
    return cov.class_pair_scatter(x.withColumns({"key": key, "x": F.col("feat")}), F.col("x"), label="key")


def map_by_camera_pair(samples: DataFrame, metrics: DataFrame, mean: bool = False) -> DataFrame:
    """map, n_queries, rank1 of distances under the metric of each pair of cameras, or under the mean of all: metrics(test_cam, query_cam, m)."""
    if mean:
        rows = [r["m"] for r in metrics.select("m").collect()]  # one matrix a pair of cameras
        m = [[sum(r[i][j] for r in rows) / len(rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]
        metrics = samples.sparkSession.createDataFrame([(a, b, m) for a, b in metrics.select("test_cam", "query_cam").collect()], "test_cam int, query_cam int, m array<array<double>>")
    s = score.score_by_camera_pair(samples.where("is_query"), samples.where("not is_query"), metrics)
    return evaluate.mean_average_precision(cut(s.withColumn("score", -F.col("score"))))


def types_and_fusion(scores: DataFrame, max_rank: int) -> DataFrame:
    """type, rank, rate of scores(trial, probe, gallery, match, type, score): the symmetric curve of every type and of their fusion."""
    types = [r["type"] for r in scores.select("type").distinct().collect()]  # a handful of feature types
    keys = ("trial", "probe", "gallery", "match")
    product = scores.groupBy(*keys).agg(F.exp(F.sum(F.log(F.abs("score"))) / len(types)).alias("score"), F.min(F.abs("score")).alias("low"))
    fused = product.select(*keys, F.when(F.col("low") == 0, 0.0).otherwise(F.col("score")).alias("score"))
    out = evaluate.symmetric_cmc(fused, max_rank).select(F.lit("fused").alias("type"), "rank", "rate")
    for t in sorted(types):
        part = evaluate.symmetric_cmc(scores.where(F.col("type") == t).select(*keys, "score"), max_rank)
        out = out.unionByName(part.select(F.lit(t).alias("type"), "rank", "rate"))
    return out


def large_margin_errors(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """measure, error: the share of rows of another person that vote or energy give, before and under a large-margin metric fitted on train."""
    l, _ = learners.lmnn(train, k)
    moved = lambda x: cut(x.withColumn("x", vec.matvec(vec.matrix(l), F.col("x"))))
    out = None
    for name, a, b in (("euclid", train, test), ("metric", moved(train), moved(test))):
        own, other = cut(knn.neighbours(a, a, k, skip_self=True)), cut(knn.neighbours(b, a, k))
        for what, near in (("train", own), ("test", other)):
            part = knn.error_rate(near, (k,)).select(F.lit(f"{name}_{what}").alias("measure"), "error")
            out = part if out is None else out.unionByName(part)
    wrong = (F.col("truth") != F.col("label")).cast("double")
    return out.unionByName(knn.energy_classify(b, a, k).agg(F.lit("energy_test").alias("measure"), F.avg(wrong).alias("error")))


def trials(samples: DataFrame, splits: DataFrame, learner: str, ranks: int) -> DataFrame:
    """rank, rate: each trial trains on what its split leaves and matches the split's rows under camera 0 with those under camera 1; averaged over trials."""
    out = None
    for r in splits.select("trial").distinct().orderBy("trial").collect():  # a handful of trials
        train, test = split_trial(samples, splits, r["trial"])
        _, m = train_metric(train, learner)
        moved = cut(test.withColumn("x", vec.matvec(vec.matrix(factor(m)), F.col("x"))))
        s = score.score(moved.where("cam = 0"), moved.where("cam = 1"), vec.squared_distance)
        s = s.select(F.col("probe_id").alias("probe"), F.col("gallery_id").alias("gallery"), (F.col("probe_person") == F.col("gallery_person")).alias("match"), "score")
        part = evaluate.matching_cmc(s, ranks)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rank").agg(F.avg("rate").alias("rate"))


def half_split_trials(samples: DataFrame, trials: int, ranks: int) -> DataFrame:
    """rank, rate: the match curve of discriminant metrics over random halves of the persons, averaged."""
    out = None
    for t in range(trials):
        x = pairs.half_split(samples, "person", t)
        train, test = x.where("not test"), x.where("test")
        w, m = learners.xqda(train)
        l = vec.matrix(factor(learners.psd(m)) @ w.T)
        moved = cut(test.withColumn("x", vec.matvec(l, F.col("x"))))
        s = score.score(moved.where("cam = 0"), moved.where("cam = 1"), vec.squared_distance)
        s = s.select(F.col("probe_id").alias("probe"), F.col("gallery_id").alias("gallery"), (F.col("probe_person") == F.col("gallery_person")).alias("match"), (-F.col("score")).alias("score"))
        part = evaluate.closed_set_cmc(s, ranks)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rank").agg(F.avg("rate").alias("rate"))
