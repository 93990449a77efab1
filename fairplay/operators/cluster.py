"""Clustering of player profiles.

Two data shapes are used:

* wide rows with a ``features`` vector for the MLlib fits (KMeans,
  GaussianMixture, BisectingKMeans, PCA), and
* long rows (id, feature, value) for the per-cluster statistics, so every
  statistic is a ``groupBy(label, feature)`` aggregate (k x d groups) and
  nothing per cluster is collected.

Only model-size results reach the driver: fitted centres, costs for the
k sweep, the micro-cluster centroids for the Ward merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairplay.plans.joins import bounded_broadcast
from fairplay.session import cut_lineage

NOISE = -1
FEW_CENTRES = 64  # that may enter a plan as literals
ROWS_PER_TASK = 50_000  # of k-means fits, which run a small job per iteration
# Fixed values (must equal the reference's for equal results).
WORDING = [("foul", "high fouling tendency", "low fouling tendency"),
           ("card", "frequent cards", "disciplined play"),
           ("minute", "high playing time", "limited playing time")]


# ---------------------------------------------------------------- shapes
def to_long(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    return df.select(F.col(id_col).alias("id"),
                     F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))


def standardize_long(long: DataFrame) -> DataFrame:
    """(x - mean) / std_pop per feature; zero std -> x - mean (the F21 rule)."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    j = long.join(bounded_broadcast(stats), "feature")
    den = F.when(F.col("_s").isNull() | (F.col("_s") == 0), F.lit(1.0)).otherwise(F.col("_s"))
    return j.select("id", "feature", ((F.col("value") - F.col("_m")) / den).alias("value"))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def scale_wide(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Wide form of the F21 rule (population std), null-safe."""
    from fairplay.operators.features import fit_scaler, scale

    return scale(df, fit_scaler(df, features), features)


# ---------------------------------------------------------------- K1, K2, K4
def fit_frame(vectors: DataFrame, features: str = "features") -> DataFrame:
    """The vectors alone, checkpointed and cached, for fits of many small jobs: a task per
    ``ROWS_PER_TASK`` rows, so an iteration costs by the rows, not by the shuffle partitions."""
    rows = cut_lineage(vectors.select(features))
    return cut_lineage(rows.repartition(max(1, -(-rows.count() // ROWS_PER_TASK)), F.xxhash64(vector_to_array(features)))).cache()


def kmeans_best(vectors: DataFrame, k: int = 5, restarts: int = 10, max_iter: int = 300,
                seed: int = 42, features: str = "features", threads: int = 8):
    """K1: best of ``restarts`` k-means fits by training cost, the first of equals. The fits are
    independent: they read one cached frame and run from a few driver threads."""
    rows = fit_frame(vectors, features)

    def one(r: int):
        model = KMeans(k=k, maxIter=max_iter, seed=seed + r, featuresCol=features).fit(rows)
        return model, model.summary.trainingCost

    with ThreadPoolExecutor(max_workers=threads) as pool:
        fits = list(pool.map(one, range(restarts)))
    rows.unpersist()
    return min(fits, key=lambda f: f[1])


def gaussian_mixture(vectors: DataFrame, k: int = 5, seed: int = 42, features: str = "features"):
    """K2: full-covariance mixture; hard labels = most probable component."""
    return GaussianMixture(k=k, seed=seed, featuresCol=features, maxIter=100).fit(vectors)


def ward_merge(centroids: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Weighted Ward agglomeration of a few centroids down to k groups.

    Runs on the micro-cluster centroids only (k x 20 points); returns the
    group of each centroid.
    """
    groups = [[i] for i in range(len(centroids))]
    cent = [centroids[i].astype(float) for i in range(len(centroids))]
    w = [float(x) for x in weights]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                if w[a] + w[b] == 0:
                    cost = 0.0
                else:
                    cost = w[a] * w[b] / (w[a] + w[b]) * float(np.sum((cent[a] - cent[b]) ** 2))
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        tot = w[a] + w[b]
        cent[a] = (cent[a] * w[a] + cent[b] * w[b]) / tot if tot else cent[a]
        w[a] = tot
        groups[a] += groups[b]
        del groups[b], cent[b], w[b]
    label = np.zeros(len(centroids), dtype=int)
    for g, members in enumerate(groups):
        for m in members:
            label[m] = g
    return label


def hierarchical(vectors: DataFrame, k: int = 5, micro_per_cluster: int = 20, seed: int = 42,
                 features: str = "features") -> DataFrame:
    """K4 (re-aimed): k x 20 k-means micro-clusters on Spark, Ward merge of their
    centroids, labels joined back through a small micro -> group table."""
    n_micro = k * micro_per_cluster
    vectors = cut_lineage(vectors)  # the fit caches rows of a file, not those of a running merge join
    rows = fit_frame(vectors, features)
    km = KMeans(k=n_micro, seed=seed, featuresCol=features, maxIter=50).fit(rows)
    rows.unpersist()
    assigned = km.transform(vectors).withColumnRenamed("prediction", "_micro")
    sizes = {r["_micro"]: r["n"] for r in
             assigned.groupBy("_micro").agg(F.count(F.lit(1)).alias("n")).collect()}
    cents = np.array([c for c in km.clusterCenters()])
    weights = np.array([sizes.get(i, 0) for i in range(len(cents))])
    group = ward_merge(cents, weights, k)
    spark = vectors.sparkSession
    mapping = spark.createDataFrame([(int(i), int(g)) for i, g in enumerate(group)],
                                    "_micro int, label int")
    return assigned.join(F.broadcast(mapping), "_micro").drop("_micro")


def bisecting(vectors: DataFrame, k: int = 5, seed: int = 42, features: str = "features"):
    return BisectingKMeans(k=k, seed=seed, featuresCol=features).fit(vectors)


# ---------------------------------------------------------------- K5
def lloyd(rows: DataFrame, starts: Sequence[np.ndarray], max_iter: int, features: str = "features",
          tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(centres, cost) of the k-means fit from each start, as MLlib's turns give them (an empty
    cluster keeps its centre; a fit ends when no centre moves by more than ``tol``). All fits
    share a pass over the rows per turn; a row per centre comes back."""
    centres, cost, live = list(starts), [0.0] * len(starts), list(range(len(starts)))
    d = centres[0].shape[1]
    tasks = max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)  # a turn is work enough for all cores
    slim = cut_lineage(rows.select(vector_to_array(features).alias("x")).repartition(tasks)).cache()
    names = [f"s{j}" for j in range(d)]
    schema = "fit int, c int, n long, cost double, " + ", ".join(f"{n} double" for n in names)
    for _ in range(max_iter):
        sent = rows.sparkSession.sparkContext.broadcast([(f, centres[f]) for f in live])  # of the models' size
        sums = slim.mapInArrow(_turn(sent), schema).groupBy("fit", "c").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(n).alias(n) for n in names]).toPandas()
        sent.unpersist()
        moved = set()
        for f, part in sums.groupby("fit"):
            part = part[part["n"] > 0]
            new, at = centres[f].copy(), part["c"].to_numpy()
            new[at] = part[names].to_numpy() / part["n"].to_numpy()[:, None]
            if ((new - centres[f]) ** 2).sum(axis=1).max() > tol * tol:
                moved.add(f)
            centres[f], cost[f] = new, float(part["cost"].sum())
        live = [f for f in live if f in moved]
        if not live:
            break
    slim.unpersist()
    return list(zip(centres, cost, strict=True))


def _turn(sent):
    """Rows of the vectors -> per fit and centre: the number, cost and sum of its nearest rows."""

    def run(batches):
        fits = sent.value
        ends = np.cumsum([len(c) for _, c in fits])
        spans = [(end - len(c), end) for end, (_, c) in zip(ends, fits, strict=True)]
        stack = np.vstack([c for _, c in fits])
        half, (m, d) = (stack ** 2).sum(axis=1), stack.shape
        n, cost, total = np.zeros(m), np.zeros(m), np.zeros((m, d))
        for batch in batches:
            x_all = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for x in (x_all[i:i + 2048] for i in range(0, len(x_all), 2048)):
                far = half - 2 * (x @ stack.T)
                near, at, own = np.zeros_like(far), np.arange(len(x)), (x ** 2).sum(axis=1)
                for lo, hi in spans:
                    c = lo + far[:, lo:hi].argmin(axis=1)
                    near[at, c] = 1.0
                    cost += np.bincount(c, np.maximum(far[at, c] + own, 0.0), m)
                n += near.sum(axis=0)
                total += near.T @ x
        ids = [(f, c) for f, centre in fits for c in range(len(centre))]
        cols = [pa.array([f for f, _ in ids], pa.int32()), pa.array([c for _, c in ids], pa.int32()), pa.array(n.astype(np.int64)),
                pa.array(cost), *[pa.array(total[:, j]) for j in range(d)]]
        yield pa.RecordBatch.from_arrays(cols, names=["fit", "c", "n", "cost", *[f"s{j}" for j in range(d)]])

    return run


def elbow_k(ks: Sequence[int], inertias: Sequence[float]) -> int:
    """argmax of the second difference of inertia; fewer than 3 points -> first k."""
    if len(ks) < 3:
        return ks[0]
    d2 = [inertias[i - 1] - 2 * inertias[i] + inertias[i + 1] for i in range(1, len(ks) - 1)]
    return ks[1 + int(np.argmax(d2))]


def find_optimal_k(vectors: DataFrame, max_k: int = 15, seed: int = 42,
                   features: str = "features", id_col: str = "id", starts: int = 10,
                   threads: int = 8) -> tuple[DataFrame, dict]:
    """K5: for each k in 2..max_k the best of ``starts`` fits by inertia; inertia, silhouette
    (squared Euclidean), Calinski-Harabasz and Davies-Bouldin per k; best k per method and the
    mode of elbow, silhouette and Calinski-Harabasz (ties -> smallest k), also as columns.

    The starts are independent and chosen from a few driver threads; the turns of all fits share
    their passes over one cached frame (``lloyd``).
    """
    vectors = cut_lineage(vectors)
    rows = fit_frame(vectors, features)
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")

    ks = list(range(2, max_k + 1))
    jobs = [(k, s) for k in ks for s in range(starts)]

    def first(job: tuple[int, int]) -> np.ndarray:  # no turns: the chosen starting centres
        return np.array(KMeans(k=job[0], seed=seed + job[1], featuresCol=features, maxIter=0).fit(rows).clusterCenters())

    def one(job: tuple[int, tuple[np.ndarray, float]]) -> tuple:
        k, (centres, cost) = job
        pred = cut_lineage(assign_nearest(rows, list(enumerate(centres)), features))
        ch, db = vector_metrics(pred, features)
        return k, float(cost), float(ev.evaluate(pred)), ch, db

    with ThreadPoolExecutor(max_workers=threads) as pool:
        fits = lloyd(rows, list(pool.map(first, jobs)), 300, features)
        per_k = [(k, min((f for f, job in zip(fits, jobs, strict=True) if job[0] == k), key=lambda f: f[1])) for k in ks]
        found = list(pool.map(one, per_k))
    rows.unpersist()
    best = {
        "elbow": elbow_k(ks, [r[1] for r in found]),
        "silhouette": ks[int(np.argmax([r[2] for r in found]))],
        "calinski_harabasz": ks[int(np.argmax([r[3] if r[3] is not None else -np.inf for r in found]))],
        "davies_bouldin": ks[int(np.argmin([r[4] if r[4] is not None else np.inf for r in found]))],
    }
    votes = [best["elbow"], best["silhouette"], best["calinski_harabasz"]]
    counts = {k: votes.count(k) for k in votes}
    top = max(counts.values())
    best["consensus"] = min(k for k, c in counts.items() if c == top)
    table = vectors.sparkSession.createDataFrame(
        [(*r, *[r[0] == b for b in best.values()]) for r in found],
        "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, "
        + ", ".join(f"best_{m} boolean" for m in best))
    return table, best


def vector_metrics(pred: DataFrame, features: str = "features") -> tuple[float | None, float | None]:
    """(Calinski-Harabasz, Davies-Bouldin) of ``prediction``, as ``cluster_metrics`` has them, in two
    passes over the vectors: sums per cluster, then distances to the centres; k rows come back each."""
    from pyspark.ml.stat import Summarizer

    sums = pred.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col(features)).alias("mu")).collect()
    if len(sums) < 2:
        return None, None
    mu = {r["prediction"]: r["mu"].toArray() for r in sums}
    at = F.element_at(F.create_map(*[F.lit(v) for c, m in mu.items() for v in (c, m.tolist())]), F.col("prediction"))
    sq = F.aggregate(F.zip_with(vector_to_array(features), at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    far = pred.select("prediction", sq.alias("sq")).groupBy("prediction").agg(F.sum("sq").alias("sq"), F.avg(F.sqrt("sq")).alias("s")).collect()
    n, k = sum(r["n"] for r in sums), len(sums)
    grand = sum(r["n"] * mu[r["prediction"]] for r in sums) / n
    between = sum(r["n"] * float(np.sum((mu[r["prediction"]] - grand) ** 2)) for r in sums)
    within, s = sum(r["sq"] for r in far), {r["prediction"]: r["s"] for r in far}
    ch = (between / (k - 1)) / (within / (n - k)) if n > k and within else None
    worst = []
    for i in mu:
        apart = [(s[i] + s[j], float(np.sqrt(np.sum((mu[i] - mu[j]) ** 2)))) for j in mu if j != i]
        ratios = [a / d for a, d in apart if d]
        worst += [max(ratios)] if ratios else []
    return ch, float(np.mean(worst)) if worst else None


# ---------------------------------------------------------------- K7, K8
def centers(long: DataFrame, labels: DataFrame) -> DataFrame:
    """K8: mean per (label, feature), noise excluded."""
    pts = long.join(labels.where(F.col("label") != NOISE), "id")
    return pts.groupBy("label", "feature").agg(F.avg("value").alias("center"))


def cluster_metrics(long: DataFrame, labels: DataFrame) -> DataFrame:
    """K7: clusters, noise, silhouette (squared Euclidean, as Spark's evaluator),
    Calinski-Harabasz and Davies-Bouldin; noise excluded; one row.

    Silhouette uses per-cluster sums (n_c, sum of vectors, sum of squared
    norms) so the cost is O(n x k), never pairs of points.
    """
    lab = labels.where(F.col("label") != NOISE)
    pts = long.join(lab, "id")
    n_noise = labels.agg(F.count_if(F.col("label") == NOISE).alias("noise_points"))
    csum = pts.groupBy("label", "feature").agg(F.sum("value").alias("s"), F.avg("value").alias("mu"))
    ccount = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    norms = pts.groupBy("id", "label").agg(F.sum(F.col("value") ** 2).alias("nx"))
    qc = norms.groupBy("label").agg(F.sum("nx").alias("q_c"))
    stats = ccount.join(qc, "label")
    # x . S_c for every point and every cluster: join on feature with the k x d sums.
    dots = (pts.select("id", "feature", "value")
            .join(bounded_broadcast(csum.select(F.col("label").alias("c"), "feature", "s")), "feature")
            .groupBy("id", "c").agg(F.sum(F.col("value") * F.col("s")).alias("xs")))
    per = (dots.join(norms, "id")
           .join(bounded_broadcast(stats.select(F.col("label").alias("c"), "n_c", "q_c")), "c"))
    dist_sum = F.col("n_c") * F.col("nx") - 2 * F.col("xs") + F.col("q_c")
    own = F.col("c") == F.col("label")
    per = per.select("id", "label", own.alias("own"), "n_c",
                     F.when(own, F.try_divide(dist_sum, F.col("n_c") - 1))
                     .otherwise(dist_sum / F.col("n_c")).alias("d"))
    sil_pt = per.groupBy("id").agg(
        F.max(F.when(F.col("own"), F.col("d"))).alias("a"),
        F.max(F.when(F.col("own"), F.col("n_c"))).alias("n_own"),
        F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    sil = F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    silhouette = sil_pt.agg(F.avg(sil).alias("silhouette_sq_euclidean"))
    # Calinski-Harabasz from the same sums.
    grand = pts.groupBy("feature").agg(F.avg("value").alias("g"))
    cm = csum.join(ccount, "label").join(bounded_broadcast(grand), "feature")
    between = cm.agg(F.sum(F.col("n_c") * (F.col("mu") - F.col("g")) ** 2).alias("bss"))
    within_rows = (pts.join(bounded_broadcast(csum.select("label", "feature", "mu")), ["label", "feature"])
                   .select("id", "label", ((F.col("value") - F.col("mu")) ** 2).alias("sq")))
    within = within_rows.agg(F.sum("sq").alias("wss"))
    sizes = lab.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_clusters"))
    # Davies-Bouldin: scatter s_c = mean distance to the own centre; centre pairs
    # come from a self join of the k x d centre table on the feature.
    dist_pt = within_rows.groupBy("id", "label").agg(F.sqrt(F.sum("sq")).alias("dist"))
    scatter = dist_pt.groupBy("label").agg(F.avg("dist").alias("s_c"))
    ca = csum.select(F.col("label").alias("i"), "feature", F.col("mu").alias("mi"))
    cb = csum.select(F.col("label").alias("j"), "feature", F.col("mu").alias("mj"))
    pair = (ca.join(cb, "feature").where(F.col("i") != F.col("j"))
            .groupBy("i", "j").agg(F.sqrt(F.sum((F.col("mi") - F.col("mj")) ** 2)).alias("d_ij")))
    pair = (pair.join(scatter.select(F.col("label").alias("i"), F.col("s_c").alias("s_i")), "i")
            .join(scatter.select(F.col("label").alias("j"), F.col("s_c").alias("s_j")), "j"))
    ratio = pair.groupBy("i").agg(F.max(F.try_divide(F.col("s_i") + F.col("s_j"), F.col("d_ij")))
                                  .alias("r_i"))
    db = ratio.agg(F.avg("r_i").alias("davies_bouldin"))
    from fairplay.operators.queries import attach_scalar

    out = attach_scalar(attach_scalar(attach_scalar(attach_scalar(attach_scalar(
        sizes, n_noise), silhouette), between), within), db)
    ch = F.when(F.col("n_clusters") < 2, None).otherwise(
        F.try_divide(F.col("bss") / (F.col("n_clusters") - 1),
                     F.col("wss") / (F.col("n") - F.col("n_clusters"))))
    return out.select("n_clusters", "noise_points", "silhouette_sq_euclidean",
                      ch.alias("calinski_harabasz"),
                      F.when(F.col("n_clusters") < 2, None).otherwise(F.col("davies_bouldin"))
                      .alias("davies_bouldin"))


# ---------------------------------------------------------------- K9, K10, K11, K14
def cluster_profiles(long: DataFrame, labels: DataFrame) -> DataFrame:
    """K9: size, percent and mean/std/min/max per (cluster, feature)."""
    lab = labels.where(F.col("label") != NOISE)
    total = labels.agg(F.count(F.lit(1)).alias("_n"))
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    from fairplay.operators.queries import attach_scalar

    sizes = attach_scalar(sizes, total).select("label", "size",
                                               (F.col("size") / F.col("_n") * 100.0).alias("percent"))
    stats = long.join(lab, "id").groupBy("label", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(bounded_broadcast(sizes), "label")


def cluster_medians(long: DataFrame, labels: DataFrame, accuracy: int = 10000) -> DataFrame:
    """K9 medians, exact: a sketch brackets the middle, values below the bracket are
    counted and only the distinct values inside it are ranked, so a hot cluster is
    never held whole."""
    lab = labels.where(F.col("label") != NOISE)
    pts = long.join(lab, "id").where(F.col("value").isNotNull())
    keys = ["label", "feature"]
    slack = 2.0 / accuracy
    around = pts.groupBy(*keys).agg(
        F.percentile_approx("value", [0.5 - slack, 0.5 + slack], accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    near = pts.join(around, keys)
    below = near.groupBy(*keys).agg(F.count_if(F.col("value") < F.col("q")[0]).alias("below"))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = (near.where(F.col("value").between(F.col("q")[0], F.col("q")[1]))
              .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
              .join(below, keys).withColumn("upto", F.col("below") + F.sum("c").over(w)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
    return inside.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median"))


def top_features(long: DataFrame, labels: DataFrame, k: int = 5,
                 feature_order: Sequence[str] | None = None) -> DataFrame:
    """|(cluster mean - overall mean) / overall mean| (inf/NaN -> 0), top k per cluster."""
    overall = long.groupBy("feature").agg(F.avg("value").alias("overall_mean"))
    cm = long.join(labels.where(F.col("label") != NOISE), "id").groupBy("label", "feature").agg(
        F.avg("value").alias("cluster_mean"))
    j = cm.join(bounded_broadcast(overall), "feature")
    imp = F.coalesce(F.abs(F.try_divide(F.col("cluster_mean") - F.col("overall_mean"),
                                        F.col("overall_mean"))), F.lit(0.0))
    j = j.withColumns({"importance": imp,
                       "difference": F.col("cluster_mean") - F.col("overall_mean")})
    tie = _feature_position(feature_order) if feature_order else F.col("feature")
    w = Window.partitionBy("label").orderBy(F.col("importance").desc(), tie)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _feature_position(order: Sequence[str]) -> Column:
    expr = F.lit(len(order))
    for i, f in reversed(list(enumerate(order))):
        expr = F.when(F.col("feature") == f, F.lit(i)).otherwise(expr)
    return expr


def interpret(top: DataFrame, sizes: DataFrame) -> DataFrame:
    """Phrase from the first 3 top features; else 'Cluster i - n players'."""
    name = F.lower(F.col("feature"))
    higher = F.col("cluster_mean") > F.col("overall_mean")
    phrase = None
    for word, hi, lo in WORDING:
        arm = F.when(higher, F.lit(hi)).otherwise(F.lit(lo))
        phrase = (F.when(name.contains(word), arm) if phrase is None
                  else phrase.when(name.contains(word), arm))
    parts = (top.where(F.col("rank") <= 3).select("label", "rank", phrase.alias("phrase"))
             .groupBy("label").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.when(F.col("phrase").isNotNull(),
                                                    F.struct("rank", "phrase")))),
                 lambda s: s["phrase"]), ", ").alias("parts")))
    j = sizes.select("label", "size").join(parts, "label", "left")
    return j.select("label", F.when(F.coalesce(F.col("parts"), F.lit("")) != "",
                                    F.concat(F.lit("Players with "), F.col("parts")))
                    .otherwise(F.concat(F.lit("Cluster "), F.col("label").cast("string"),
                                        F.lit(" - "), F.col("size").cast("string"),
                                        F.lit(" players"))).alias("interpretation"))


def examples(labels: DataFrame, n: int = 5, seed: int = 42, salts: int = 64) -> DataFrame:
    """N repeatable 'random' members per cluster (smallest hash of id and seed).

    Two-stage top-n: first per (cluster, salt) so a huge cluster is split over
    ``salts`` tasks, then over the <= salts x n survivors per cluster.
    """
    h = F.xxhash64(F.col("id"), F.lit(seed))
    x = labels.where(F.col("label") != NOISE).withColumns({"_h": h, "_salt": F.pmod(h, F.lit(salts))})
    w1 = Window.partitionBy("label", "_salt").orderBy("_h", "id")
    stage1 = x.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy("label").orderBy("_h", "id")
    return (stage1.withColumn("example_rank", F.row_number().over(w2))
            .where(F.col("example_rank") <= n).select("label", "id", "example_rank"))


# ---------------------------------------------------------------- K12, K13
def assign_nearest(vectors: DataFrame, centres: Sequence[tuple[int, Sequence[float]]],
                   features: str = "features") -> DataFrame:
    """K12 for models without ``transform`` (density clusters): nearest centre.

    ``centres`` are model-size (one per cluster) and enter the plan as literals:
    one projection, no join.
    """
    x = vector_to_array(features)
    dists = []
    for label, c in centres:
        d = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]),
                                   lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
        dists.append(F.struct(d.alias("d"), F.lit(int(label)).alias("label")))
    best = F.array_min(F.array(*dists))
    return vectors.withColumn("prediction", best["label"])


def centre_rows(vectors: DataFrame, labels: DataFrame, features: str = "features") -> DataFrame:
    """(label, centre), the mean vector of each cluster (noise excluded)."""
    from pyspark.ml.stat import Summarizer

    return (vectors.join(labels.where(F.col("label") != NOISE), "id").groupBy("label")
            .agg(Summarizer.mean(F.col(features)).alias("centre")))


def _collected(centres: DataFrame) -> list[tuple[int, list[float]]]:
    """The rows of a few centres, in order of the label."""
    return [(r["label"], r["centre"].toArray().tolist()) for r in centres.orderBy("label").collect()]


def assign_to_clusters(vectors: DataFrame, fitted: DataFrame, labels: DataFrame, features: str = "features") -> DataFrame:
    """K12, density form: ``vectors`` with ``prediction``, the cluster of ``labels`` (over the ids of
    ``fitted``) whose centre is nearest; noise where there is no cluster."""
    from fairplay.operators.neighbors import nearest_place

    centres = cut_lineage(centre_rows(fitted, labels, features))
    n = centres.count()
    if n <= FEW_CENTRES:
        few = _collected(centres)
        return assign_nearest(vectors, few, features) if few else vectors.withColumn("prediction", F.lit(NOISE))
    # Density clusters grow with the rows: their centres stay rows.
    rows = cut_lineage(vectors.withColumn("_key", F.monotonically_increasing_id()))
    found = nearest_place(rows.select(F.col("_key").alias("key"), vector_to_array(features).alias("x")),
                          centres.select("label", vector_to_array("centre").alias("x")))
    least = centres.agg(F.min("label")).first()[0]  # for rows without a distance
    out = rows.join(found.select(F.col("key").alias("_key"), F.col("label").alias("prediction")), "_key", "left").drop("_key")
    return out.withColumn("prediction", F.coalesce("prediction", F.lit(least).cast("long")))


def pca_scatter(vectors: DataFrame, labels: DataFrame, k: int = 2, features: str = "features") -> DataFrame:
    """(kind, id, label, pc1.., ratio1..): the points, and the clusters' centres, in the plane of
    the first components, with each component's share of the variance. The projection is linear,
    so a centre's image is the mean of its points' images."""
    projected, ratios = pca_projection(vectors, k, features)
    pcs = [f"pc{j + 1}" for j in range(k)]
    points = projected.select("id", *pcs).join(labels, "id", "left")
    marks = points.where(F.col("label") != NOISE).groupBy("label").agg(*[F.avg(c).alias(c) for c in pcs])
    rows = points.select(F.lit("point").alias("kind"), "id", "label", *pcs).unionByName(
        marks.select(F.lit("centre").alias("kind"), F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"), "label", *pcs))
    return rows.withColumns({f"ratio{j + 1}": F.lit(float(r)) for j, r in enumerate(ratios)})


def pca_projection(vectors: DataFrame, k: int = 2, features: str = "features"):
    """Standardise (mean 0), PCA with k components, sign fixed so the largest
    absolute loading of each component is positive. Returns (projected, variance ratio)."""
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler

    sc = StandardScaler(inputCol=features, outputCol="_sample", withMean=True, withStd=True).fit(vectors)
    n = max(vectors.count(), 2)
    to_population = [(n / (n - 1)) ** 0.5] * sc.mean.size  # the scaler divides by the sample deviation
    std = ElementwiseProduct(scalingVec=Vectors.dense(to_population), inputCol="_sample", outputCol="_std").transform(
        sc.transform(vectors)).drop("_sample")
    model = PCA(k=k, inputCol="_std", outputCol="_pc").fit(std)
    pcs = model.pc.toArray()
    signs = np.array([1.0 if pcs[np.argmax(np.abs(pcs[:, j])), j] >= 0 else -1.0 for j in range(k)])
    out = model.transform(std).withColumn("_arr", vector_to_array("_pc"))
    for j in range(k):
        out = out.withColumn(f"pc{j + 1}", F.col("_arr")[j] * float(signs[j]))
    return out.drop("_std", "_pc", "_arr"), list(model.explainedVariance.toArray())
