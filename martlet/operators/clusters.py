"""K-Means customer clusters on log-scaled features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.numbers import fetched, mean, total
from martlet.functions.windows import everything, share_of_all
from martlet.operators import kmeans

#: Starts that are tried for each number of clusters.
SEEDS = (42, 43, 44, 45, 46, 47, 48, 49, 50, 51)

# Clustering features, and which of them are taken as log(1 + x).
FEATURES = ["recency", "frequency", "monetary", "aov", "n_categories"]
LOG_FEATURES = ["frequency", "monetary", "aov", "n_categories"]


def feature(c: str, log_features: Sequence[str] = LOG_FEATURES) -> Column:
    return F.log1p(F.col(c).cast("double")) if c in log_features else F.col(c).cast("double")


def feature_matrix(customers: DataFrame, features: Sequence[str] = FEATURES,
                   log_features: Sequence[str] = LOG_FEATURES) -> DataFrame:
    """Key and numeric features, skewed ones on a log scale."""
    return customers.select("customer_unique_id", *[feature(c, log_features).alias(c) for c in features])


def scales(matrix: DataFrame, features: Sequence[str] = FEATURES) -> Callable[[str, Column], Column]:
    """Scales a feature by its mean and *population* deviation over the rows; a constant feature becomes zero."""
    names = [f"{s}_{c}" for c in features for s in ("m", "s")]
    stats = fetched(matrix.agg(*[a for c in features for a in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]), *names)
    return lambda c, value: F.coalesce(F.try_divide(value - stats[f"m_{c}"], stats[f"s_{c}"]), F.lit(0.0))


def standardise(matrix: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean zero and *population* deviation one; a constant feature becomes zero."""
    scale = scales(matrix, features)
    return matrix.select("customer_unique_id", *[scale(c, F.col(c)).alias(c) for c in features])


def points_of(customers: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Standardised features of every customer, as points of ``martlet.operators.kmeans``."""
    return kmeans.point_frame(standardise(feature_matrix(customers, features)), "customer_unique_id", features)


@contextmanager
def held(points: DataFrame) -> Iterator[DataFrame]:
    """Points dealt to all cores and kept by the executors while fits pass over them, and released at the end."""
    points = kmeans.dealt(points).persist()
    try:
        yield points
    finally:
        points.unpersist()


def scan_k(points: DataFrame, ks: Sequence[int] = range(2, 9), seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Per k the best of several starts: inertia, silhouette (squared Euclidean, all points), and how it was reached."""
    with held(points) as points:
        best = kmeans.best_fits(kmeans.fit_many(points, ks, seeds))
        scores = kmeans.silhouettes(points, best)
    rows = [(f.k, f.inertia, s, len(seeds), f.seed, f.steps, f.converged) for f, s in zip(best, scores)]
    found = points.sparkSession.createDataFrame(rows, "k bigint, inertia double, silhouette double, starts bigint, best_seed bigint, steps bigint, converged boolean")
    before = F.lag("inertia").over(everything().orderBy("k"))
    return found.withColumn("inertia_drop_pct", 100.0 * (before - F.col("inertia")) / before).orderBy("k")


def decomposition(points: DataFrame, ks: Sequence[int] = range(2, 9), seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Per k: customers in all clusters, and squared distances within clusters plus those between them.

    Their sum is that of the points themselves, whatever the clusters are, so it can be held against the features.
    """
    with held(points) as points:
        best = kmeans.best_fits(kmeans.fit_many(points, ks, seeds))
    rows = [(f.k, sum(f.n), f.inertia + f.between) for f in best]
    return points.sparkSession.createDataFrame(rows, "k bigint, customers bigint, total_squares double").withColumn("total_squares", F.round("total_squares", 1))


def cluster_profile(clustered: DataFrame) -> DataFrame:
    groups = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
        mean("monetary").alias("avg_monetary"), F.avg("aov").alias("avg_aov"), F.avg("n_categories").alias("avg_categories"),
        F.avg("total_items").alias("avg_items"), total("monetary").alias("revenue"), F.avg("avg_review").alias("avg_review"))
    return groups.select("*", share_of_all("customers").alias("pct_of_customers"), share_of_all("revenue").alias("pct_of_revenue"))


def name_clusters(profile: DataFrame, top: float = 0.7) -> DataFrame:
    """Name clusters from their profile; percentiles are over the few clusters."""
    rich = F.percentile("avg_monetary", F.lit(top)).over(everything())
    stale = F.percentile("avg_recency", F.lit(top)).over(everything())
    # Cluster names and rule order.
    name = (F.when(F.col("avg_categories") > 1.5, "Multi-category buyers")
            .when(F.col("avg_monetary") >= F.col("rich"), "High-value single buyers")
            .when(F.col("avg_recency") >= F.col("stale"), "Dormant low-value")
            .otherwise("Recent low-value"))
    return profile.withColumns({"rich": rich, "stale": stale}).withColumn("cluster_name", name).drop("rich", "stale")


def with_clusters(customers: DataFrame, k: int = 4, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """Customers with ``cluster`` (numbered by falling size) and ``cluster_name``, from the best of several starts.

    The number is an expression over the row's own features and the fitted centres, and the names (one per cluster) are fetched,
    so no row of a customer moves.
    """
    scale = scales(feature_matrix(customers))
    wide = customers.withColumn("_x", kmeans.point([scale(c, feature(c)) for c in FEATURES]))
    with held(wide.select(F.xxhash64("customer_unique_id").alias("_hash"), "_x")) as points:
        best = kmeans.best_fits(kmeans.fit_many(points, [k], seeds))
    if not best:
        none = F.lit(None)
        return customers.withColumns({"cluster": none.cast("bigint"), "cluster_name": none.cast("string")})
    clustered = wide.withColumn("cluster", kmeans.nearest(best[0], F.col("_x"))).drop("_x")
    names = [x for r in name_clusters(cluster_profile(clustered)).select("cluster", "cluster_name").collect() for x in (F.lit(r[0]), F.lit(r[1]))]
    return clustered.withColumn("cluster_name", F.element_at(F.create_map(*names), F.col("cluster")))
