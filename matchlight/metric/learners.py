"""Learners from pairs and labels. Each gives a matrix M for distances (a-b)' M (a-b)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import cov
from .dense import inverse, psd


def pair_covariances(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean outer products of the differences x_a - x_b of matching and of other pairs, in one pass."""
    x = pairs.withColumn("__d", vec.subtract(F.col("x_a"), F.col("x_b")))
    rows = cov.scatter(x, F.col("__d"), group=F.col("match"))
    return cov.to_matrix(rows.where("grp = 'true'")), cov.to_matrix(rows.where("grp = 'false'"))


def sample_covariances(samples: DataFrame, draws: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """pair_covariances of all positives, which aren't made, and of drawn negatives."""
    from ..operators.pairs import negatives

    other = negatives(samples, draws).select(vec.subtract(F.col("x_a"), F.col("x_b")).alias("d"))
    return cov.label_pair_mean(samples), cov.to_matrix(cov.scatter(other, F.col("d")))


def kissme(positive: np.ndarray, negative: np.ndarray, share: float = 1.0, repair: bool = True) -> np.ndarray:
    """inverse(positive) - share * inverse(negative), made positive semidefinite."""
    m = inverse(positive) - share * inverse(negative)
    return psd(m) if repair else m


def mahalanobis(positive: np.ndarray) -> np.ndarray:
    return inverse(positive)


def euclidean(d: int) -> np.ndarray:
    return np.eye(d)


def xqda_features(positive: np.ndarray, negative: np.ndarray, keep: int | None = None, ridge: float = 0.001) -> np.ndarray:
    """Discriminant directions of negative against positive covariance; M in the space of the features."""
    positive = positive + ridge * np.eye(len(positive))
    w = directions(positive, negative)[1]
    w = w[:, : keep or w.shape[1]]
    return w @ psd(inverse(w.T @ positive @ w) - inverse(w.T @ negative @ w)) @ w.T


def xqda_histograms(positive: np.ndarray, negative: np.ndarray, ridge: float = 0.001) -> np.ndarray:
    """The same with the directions of ratio over 1 only, without repair."""
    positive = positive + ridge * np.eye(len(positive))
    ratio, w = directions(positive, negative)
    w = w[:, : max(1, int((ratio > 1).sum()))]
    return w @ (inverse(w.T @ positive @ w) - inverse(w.T @ negative @ w)) @ w.T


def directions(positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios, falling, and directions of inverse(positive) negative."""
    half = np.linalg.cholesky(positive)
    inner = np.linalg.solve(half, np.linalg.solve(half, negative).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    w = np.linalg.solve(half.T, vectors[:, ::-1])
    return values[::-1], w / np.linalg.norm(w, axis=0)


def xqda(samples: DataFrame, ridge: float = 0.001, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W and M from labels alone: within-person covariances by class sums, all others from the total.

    Vectors longer than there are rows are first turned into the space that the rows span (fewer rows than cells, so they fit on the driver).
    """
    head = samples.select("x").first()
    d = len(head["x"]) if head else 0
    if d and samples.limit(d).count() < d:
        span = np.linalg.qr(np.array([r["x"] for r in samples.select("x").collect()], float).T)[0]
        w, m = xqda(samples.withColumn("x", vec.matvec(vec.matrix(span.T), F.col("x"))), ridge, dims)
        return span @ w, m
    within = cov.class_pair_scatter(samples, F.col("x"))
    positive, n_within = cov.to_matrix(within, mean=False), within.first()["n"]
    whole = samples.withColumn("__one", F.lit(0))
    total = cov.class_pair_scatter(whole, F.col("x"), label="__one")
    negative, n_all = cov.to_matrix(total, mean=False), total.first()["n"]
    positive, negative = positive / max(n_within, 1), (negative - positive) / max(n_all - n_within, 1)
    positive = positive + ridge * np.eye(len(positive))
    u, s, _ = np.linalg.svd(np.linalg.solve(positive, negative))
    r = max(1, int((s > 1).sum()))
    w = u[:, : min(r, dims) if dims else r]
    return w, inverse(w.T @ positive @ w) - inverse(w.T @ negative @ w)


def itml(x: np.ndarray, constraints: list[tuple[int, int, int, float]], gamma: float = 1.0, thresh: float = 1e-2, max_iters: int = 100_000, start: np.ndarray | None = None) -> np.ndarray:
    """Cyclic Bregman projections over constraints (i, j, sign, bound) on rows of x; sequential, so on the driver over a bounded set of constraints."""
    m = np.eye(x.shape[1]) if start is None else start.copy()
    rows = [(x[i] - x[j], s, b) for i, j, s, b in constraints if np.linalg.norm(x[i] - x[j]) >= 1e-9]
    if not rows:
        return m
    slack, bound = np.zeros(len(rows)), np.array([b for _, _, b in rows], float)
    old = np.zeros(len(rows))
    done = 0
    while True:
        for k, (v, sign, _) in enumerate(rows):
            mv = m @ v
            p = v @ mv
            if sign > 0:
                alpha = min(slack[k], gamma / (gamma + 1) * (1 / p - 1 / bound[k]))
                beta = alpha / (1 - alpha * p)
                bound[k] = 1 / (1 / bound[k] + alpha / gamma)
            else:
                alpha = min(slack[k], gamma / (gamma + 1) * (1 / bound[k] - 1 / p))
                beta = -alpha / (1 + alpha * p)
                bound[k] = 1 / (1 / bound[k] - alpha / gamma)
            slack[k] -= alpha
            m += beta * np.outer(mv, mv)
            done += 1
        size = np.linalg.norm(slack) + np.linalg.norm(old)
        if size == 0 or np.abs(old - slack).sum() / size < thresh or done >= max_iters:
            return m
        old = slack.copy()


def distance_bounds(samples: DataFrame, low: float = 5, high: float = 95, draws: int = 100) -> DataFrame:
    """l and u: centres of the given ones of 100 equal-width bins over drawn squared distances."""
    from ..operators.pairs import draw, indexed

    n = samples.count()
    x = indexed(samples).select("idx", "x")
    d = samples.sparkSession.range(draws).select(draw(F.col("id"), F.lit(1), F.lit(n), 5).alias("ia"), draw(F.col("id"), F.lit(3), F.lit(n), 9).alias("ib"))
    a, b = x.select(F.col("idx").alias("ia"), F.col("x").alias("xa")), x.select(F.col("idx").alias("ib"), F.col("x").alias("xb"))
    dist = d.join(a, "ia").join(b, "ib").select(vec.squared_distance(F.col("xa"), F.col("xb")).alias("v"))
    at = lambda p: F.min("v") + F.lit((p - 0.5) / 100) * (F.max("v") - F.min("v"))
    return dist.agg(at(low).alias("l"), at(high).alias("u"))


def between(low: tuple[float, float, float], high: tuple[float, float]) -> float:
    """Where the parabola through both values and the lower slope is least, a tenth of the bracket off its ends."""
    (a, va, sa), (b, vb) = low, high
    width = b - a
    bend = vb - va - sa * width
    t = -sa * width * width / (2 * bend) if np.isfinite(bend) and bend > 0 else width / 2
    return a + min(max(t, 0.1 * width), 0.9 * width)


def beyond(before: tuple[float, float, float], now: tuple[float, float, float]) -> float:
    """Where the cubic through two values and slopes is least next, from a half to three times the last step ahead."""
    (a, va, sa), (b, vb, sb) = before, now
    width = b - a
    p = sa + sb - 3 * (vb - va) / width
    root = p * p - sa * sb
    t = 2 * width
    if root >= 0 and (below := sb - sa + 2 * np.sqrt(root)) != 0:
        least = a + width * (1 - (sb + np.sqrt(root) - p) / below)
        t = least - b if least > b else t
    return b + min(max(t, 0.5 * width), 3 * width)


def conjugate_gradient(f, x: np.ndarray, steps: int = 50) -> tuple[np.ndarray, list[float]]:
    """Minimise f(x) -> (value, gradient) by Polak-Ribiere directions and a search under the Wolfe conditions that interpolates values and slopes."""
    value, g = f(x)
    told, d, step = [value], -g, 1.0 / (1.0 + np.linalg.norm(g))
    for _ in range(steps):
        slope = g @ d
        if slope >= 0:
            d, slope = -g, -(g @ g)
        if slope == 0:
            break
        low, high, t, best = (0.0, value, slope), None, step, None
        for _ in range(25):
            v, h = f(x + t * d)
            if not np.isfinite(v) or v > value + 1e-4 * t * slope:
                high = (t, v)
                t = between(low, high)
            elif h @ d < 0.5 * slope:
                best, before, low = (t, v, h), low, (t, v, h @ d)
                t = between(low, high) if high else beyond(before, low)
            else:
                best = (t, v, h)
                break
        if best is None:
            break
        step, v, h = best
        x = x + step * d
        d = max(0.0, (h @ (h - g)) / (g @ g)) * d - h
        value, g = v, h
        told.append(value)
        if abs(told[-2] - told[-1]) < 1e-9 * max(1.0, abs(value)):
            break
    return x, told


def ldml(pairs: DataFrame, dim: int, start: np.ndarray, bias: float = 1.0, steps: int = 20) -> tuple[np.ndarray, float, list[float]]:
    """L and bias of the pair likelihood 1 / (1 + exp(|L(a-b)|^2 - bias)), classes balanced; value and gradient are summed in tasks."""
    return likelihood(pairs.select("match", vec.subtract(F.col("x_a"), F.col("x_b")).alias("d")), dim, start, bias, steps)


def ldml_labels(samples: DataFrame, dim: int, start: np.ndarray, bias: float = 1.0, steps: int = 20, draws: int = 5) -> tuple[np.ndarray, float, list[float]]:
    """ldml of all positives and of drawn negatives; positives are made in blocks in the tasks, in each evaluation anew, and not stored."""
    from ..operators import held
    from ..operators.pairs import negatives, positives

    other = negatives(samples, draws)
    blocks = held.LabelledPairs.of(samples, other.select("id_a", "id_b"))
    if blocks is None:
        rows = lambda df, match: df.select("x_a", "x_b", F.lit(match).alias("match"))
        return ldml(rows(positives(samples), True).unionByName(rows(other, False)), dim, start, bias, steps)

    def f(p: np.ndarray):
        value, grad, slope = held.likelihood(blocks, p[:-1].reshape(-1, dim), p[-1])
        return value, np.append(grad.ravel(), slope)

    p, told = conjugate_gradient(f, np.append(start.ravel(), bias), steps)
    return p[:-1].reshape(-1, dim), float(p[-1]), told


def mildml(bags: DataFrame, dim: int, start: np.ndarray, bias: float = 1.0, steps: int = 20) -> tuple[np.ndarray, float, list[float]]:
    """As ldml for bags(match, bag_a, bag_b), arrays of vectors: the members nearest under the current L stand for their bags. Empty bags are left out."""
    every = F.flatten(F.transform("bag_a", lambda a: F.flatten(F.transform("bag_b", lambda b: vec.subtract(a, b)))))
    return likelihood(bags.select("match", every.alias("d")).where(F.size("d") > 0), dim, start, bias, steps)


def likelihood(pairs: DataFrame, dim: int, start: np.ndarray, bias: float, steps: int) -> tuple[np.ndarray, float, list[float]]:
    """L, bias and the falling values for pairs(match, d): d holds the differences of a pair's members, of which the nearest counts."""
    from ..scratch import cut

    d0 = start.shape[0]
    diffs = cut(pairs)
    counts = {r["match"]: r["n"] for r in diffs.groupBy("match").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = max(counts.get(True, 0), 1), max(counts.get(False, 0), 1)

    def f(p: np.ndarray):
        l, b = p[:-1].reshape(d0, dim), p[-1]

        def part(batches):
            import pyarrow as pa

            value, grad, db = 0.0, np.zeros((d0, dim)), 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("d").offsets.to_numpy()) // dim)
                y = np.array(batch.column("match").to_pylist(), float)
                ld = d @ l.T
                z = (ld * ld).sum(axis=1) - b
                order = np.lexsort((z, owner))
                near = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
                d, ld, z = d[near], ld[near], z[near]
                w = np.where(y > 0, 1 / n_pos, 1 / n_neg)
                value += (w * np.where(y > 0, np.logaddexp(0, z), np.logaddexp(0, -z))).sum()
                r = w * (1 / (1 + np.exp(-z)) - (1 - y))
                grad += 2 * (ld * r[:, None]).T @ d
                db -= r.sum()
            yield pa.RecordBatch.from_pydict({"p": [[float(value), *grad.ravel().tolist(), float(db)]]})

        rows = diffs.mapInArrow(part, "p array<double>").select(F.posexplode("p").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(d0 * dim + 2)
        for r in rows:
            out[r["k"]] = r["v"]
        return out[0], np.append(out[1:-1], out[-1])

    p, told = conjugate_gradient(f, np.append(start.ravel(), bias), steps)
    return p[:-1].reshape(d0, dim), float(p[-1]), told


def lmnn(samples: DataFrame, k: int = 3, pull: float = 0.5, rate: float = 1e-3, steps: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """L of a large-margin metric, by gradient steps until the loss falls by less than tolerance of it; targets stay.

    A step is one comparison of all rows in blocks: a block gives its hinge sum and its d by d sum of outer products,
    so impostors are those of every step and neither they nor their triples are ever stored.
    """
    from ..operators import held as along
    from ..operators import knn, score
    from ..scratch import cut

    first = samples.select("x").first()
    d = len(first["x"]) if first else 0
    x = cut(samples.select("id", "person", "x").repartition(samples.sparkSession.sparkContext.defaultParallelism))
    targets = cut(knn.target_neighbours(x, k))
    away = targets.join(x.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i").join(x.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j")
    away = cut(away.select("i", vec.subtract(F.col("xi"), F.col("xj")).alias("d")))
    pulled = cov.to_matrix(cov.scatter(away, F.col("d")), mean=False)
    t = along.gathered(x.select("id", "x"), "id")
    moved = None
    if t is not None and not t.column("id").null_count and (np.diff(ids := t.column("id").to_numpy()) > 0).all():  # a target's id tells its vector
        moved = samples.sparkSession.sparkContext.broadcast((ids, along.cells(t)))
        by_probe = targets.groupBy(F.col("i").alias("id")).agg(F.collect_list("j").alias("away"))
    else:
        by_probe = away.groupBy(F.col("i").alias("id")).agg(F.flatten(F.collect_list("d")).alias("away"))
    del t
    probes = cut(x.join(by_probe, "id"))
    held = score.Probes(probes, ("id", "person", "away"))

    def whole(l: np.ndarray) -> tuple[float, np.ndarray]:
        def make(scores: np.ndarray, p: dict, g: dict) -> dict:
            hinge, push = 0.0, np.zeros((d, d))
            sizes = np.array([len(v) for v in p["away"]]) // (d if moved is None else 1)
            at = np.repeat(np.arange(len(sizes)), sizes)
            away_ = np.concatenate(p["away"])
            if moved is None:
                away_ = away_.astype(float).reshape(-1, d)
            else:
                away_ = p["x"][at] - moved.value[1][np.searchsorted(moved.value[0], away_)]
            far = ((away_ @ l.T) ** 2).sum(axis=1)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            limit = np.full(len(sizes), -np.inf)
            np.maximum.at(limit, at, 1 + far)
            i, j = np.nonzero(scores < limit[None, :])  # few, so that persons are compared afterwards
            other = g["person"][i] != p["person"][j]
            i, j = i[other], j[other]
            s, w = np.maximum(scores[i, j], 0.0), np.zeros(len(i))
            for r in range(max(sizes)):  # the r-th targets of all probes at once
                of = np.full(len(sizes), -1)
                of[at[nth == r]] = np.flatnonzero(nth == r)
                h = np.where(of[j] >= 0, 1 + far[of[j]] - s, 0.0)
                active = h > 0
                hinge += h[active].sum()
                n = np.bincount(j[active], minlength=len(sizes))[of >= 0]
                push += (away_[of[of >= 0]] * n[:, None]).T @ away_[of[of >= 0]]
                w += active
            if 8 * len(i) < scores.size:
                cross = g["x"][i].T @ (w[:, None] * p["x"][j])
            else:
                weight = np.zeros_like(scores)
                weight[i, j] = w
                cross = g["x"].T @ weight @ p["x"]
            by_g, by_p = (np.bincount(c, w, minlength=n) for c, n in zip((i, j), scores.shape))
            push -= (g["x"] * by_g[:, None]).T @ g["x"] + (p["x"] * by_p[:, None]).T @ p["x"] - cross - cross.T
            return {"v": [[float(hinge), *push.ravel().tolist()]]}

        def under(g: np.ndarray, p: np.ndarray) -> np.ndarray:
            """Squared distances, but for rounding at least 0, by one matrix product."""
            a, b = g @ l.T, p @ l.T
            ones = lambda x: np.ones((len(x), 1))
            return np.hstack((-2 * a, (a * a).sum(axis=1)[:, None], ones(a))) @ np.hstack((b, ones(b), (b * b).sum(axis=1)[:, None])).T

        def add(batches):
            total = np.zeros(d * d + 1)
            for b in batches:
                total += b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).sum(axis=0) if b.num_rows else 0
            yield pa.RecordBatch.from_pydict({"v": [total.tolist()]})

        parts = score.compare(held, x, under, make=make, made="v array<double>", fold=add).toArrow()  # d by d cells a task
        out = np.array(parts.column("v").to_pylist()).sum(axis=0)
        push = out[1:].reshape(d, d)
        return (1 - pull) * float(np.trace(l @ pulled @ l.T)) + pull * out[0], 2 * l @ ((1 - pull) * pulled + pull * push)

    at = best = trial = np.eye(d)
    told, recent, slope = [], [], None
    for _ in range(steps):
        loss, grad = whole(trial)
        if recent and loss > max(recent[-4:]):  # a step may climb, but not over the last four
            rate /= 4
        else:
            fell = abs(recent[-1] - loss) if recent else np.inf
            if recent:  # the next step is as long as this one's change of slope says
                step, turn = trial - at, grad - slope
                bend = (step * turn).sum()
                rate = (step * step).sum() / bend if bend > 0 else 2 * rate
            at, slope = trial, grad
            recent.append(loss)
            if not told or loss < told[-1]:
                best = trial
                told.append(loss)
            if fell < tolerance * abs(loss):
                break
        trial = at - rate * slope
    return best, told


def svm_distance(pairs: DataFrame, max_iter: int = 20) -> DataFrame:
    """id_a, id_b, match, distance: the negated margin of a linear classifier on pair features."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    x = pairs.select("id_a", "id_b", "match", F.col("match").cast("double").alias("label"), array_to_vector(vec.pair_features(F.col("x_a"), F.col("x_b"))).alias("features"))
    fitted = LinearSVC(maxIter=max_iter, regParam=0.01).fit(x)
    from pyspark.ml.functions import vector_to_array

    return fitted.transform(x).select("id_a", "id_b", "match", (-vector_to_array("rawPrediction")[1]).alias("distance"))
