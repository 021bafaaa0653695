"""Many K-Means fits at once against a plain Lloyd iteration in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.operators import clusters, kmeans
from martlet.operators.kmeans import UNIT

KS, SEEDS = (2, 3, 5), (1, 2, 3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(21)
    parts = [rng.normal(m, s, (n, 3)) for m, s, n in ((0, 0.5, 150), (4, 0.3, 60), ((8, -3, 1), 1.0, 90))]
    return np.vstack([*parts, np.repeat(parts[0][:1], 120, axis=0)])


@pytest.fixture(scope="module")
def points(spark, cloud):
    rows = [(i, *map(float, r)) for i, r in enumerate(cloud)]
    return kmeans.point_frame(spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5), "id", ["a", "b", "c"])


@pytest.fixture(scope="module")
def fits(points):
    return kmeans.fit_many(points, KS, SEEDS)


def distances(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def test_every_fit_ends_where_lloyd_ends(points, cloud, fits):
    x = np.rint(cloud * UNIT)
    begun = kmeans.starts(points, SEEDS, max(KS))
    assert [(f.k, f.seed) for f in fits] == [(k, s) for k in KS for s in SEEDS] and all(f.converged for f in fits)
    for f in fits:
        centres = begun[f.seed][:f.k].copy()
        assert len({tuple(c) for c in centres}) == f.k and all((x == c).all(axis=1).any() for c in centres)
        for _ in range(1000):
            nearest = distances(x, centres).argmin(axis=1)
            new = np.array([x[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(f.k)])
            if np.abs(new - centres).max() < 1e-3:
                break
            centres = new
        assert np.allclose(f.centres, centres, atol=2) and f.n == np.bincount(nearest, minlength=f.k).tolist()
        means = np.array([x[nearest == c].mean(axis=0) for c in range(f.k)])
        assert f.inertia == pytest.approx(distances(x, means).min(axis=1).sum() / UNIT**2, rel=1e-9)
        assert f.inertia + f.between == pytest.approx(((cloud - cloud.mean(axis=0)) ** 2).sum(), rel=1e-6)


def test_fits_do_not_depend_on_partitions(points, fits):
    again = kmeans.fit_many(points.repartition(2), KS, SEEDS)
    assert all((a.centres == b.centres).all() and a.n == b.n and a.inertia == b.inertia and a.steps == b.steps for a, b in zip(fits, again))


def test_best_of_several_starts(fits):
    best = kmeans.best_fits(fits)
    assert [f.k for f in best] == list(KS)
    assert all(f.inertia == min(g.inertia for g in fits if g.k == f.k) for f in best)
    assert all(a.inertia > b.inertia for a, b in zip(best, best[1:]))


def test_silhouettes_and_assignment(points, cloud, fits):
    best = kmeans.best_fits(fits)
    for f, got in zip(best, kmeans.silhouettes(points, best)):
        rows = kmeans.assign(points, f, "id").orderBy("id").collect()
        labels = np.array([r["cluster"] for r in rows])
        assert len(rows) == len(cloud) and sorted(np.bincount(labels).tolist(), reverse=True) == np.bincount(labels).tolist()
        means = np.array([cloud[labels == c].mean(axis=0) for c in range(f.k)])
        assert (distances(cloud, means).argmin(axis=1) == labels).all()
        apart, scores = distances(cloud, cloud), []
        for i, own in enumerate(labels):
            a = apart[i][labels == own].sum() / max(1, (labels == own).sum() - 1)
            b = min(apart[i][labels == c].mean() for c in range(f.k) if c != own)
            scores.append((b - a) / max(a, b) if (labels == own).sum() > 1 else 0.0)
        assert got == pytest.approx(np.mean(scores), abs=1e-6)


def test_few_and_no_points(spark):
    three = spark.createDataFrame([(1, 1.0, None), (2, 5.0, 2.0), (3, 5.0, 2.0), (4, float("nan"), 0.0)], "id long, a double, b double")
    points = kmeans.point_frame(three, "id", ["a", "b"])
    fits = kmeans.fit_many(points, [2, 6], [1])
    assert [len(f.centres) for f in fits] == [2, 3] and fits[1].inertia == 0 and sum(fits[1].n) == 4
    assert kmeans.fit_many(points.limit(0), [2], [1]) == []
    assert clusters.scan_k(points.limit(0), [2]).count() == 0
    short = kmeans.fit_many(points, [2], [1], most_steps=1)[0]
    assert short.steps == 1 and short.n == fits[0].n or not short.converged


def test_clusters_of_customers(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", int(rng.integers(1, 400)), int(rng.integers(1, 5)), float(rng.gamma(2, 60)), float(rng.gamma(2, 30)), int(rng.integers(1, 3)), 2, 4.0) for i in range(200)]
    people = spark.createDataFrame(rows, "customer_unique_id string, recency int, frequency int, monetary double, aov double, n_categories int, total_items int, avg_review double")
    got = clusters.with_clusters(people.withColumn("monetary", F.col("monetary").cast("decimal(18,2)")), 4).collect()
    assert len(got) == 200 and {r["cluster"] for r in got} == {0, 1, 2, 3} and all(r["cluster_name"] for r in got)
    nobody = clusters.with_clusters(people.limit(0).withColumn("monetary", F.col("monetary").cast("decimal(18,2)")))
    assert nobody.count() == 0 and {"cluster", "cluster_name"} <= set(nobody.columns)


def test_steps_use_all_cores_whatever_the_partitions(spark, points):
    with clusters.held(points.coalesce(1)) as kept:
        assert kept.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and kept.count() == points.count()


def test_nearest_of_equally_far_centres_is_that_of_plain_distances():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 24), 1 << 24, (500, 3)) * 2
    shift = rng.integers(1, 1 << 20, (2, 3)).astype(float)
    centres = np.stack([x[7] + shift, x[7] - shift, x[9] + shift[::-1]]).astype(float)  # (cluster, fit, feature)
    got = kmeans._nearest(x, centres)
    assert (got.sum(axis=0) == 1).all()
    for f in range(2):
        assert (got[:, f].argmax(axis=0) == kmeans.squared_distances(x, centres[:, f]).argmin(axis=1)).all()


def test_sums_are_exact_for_large_values():
    v = np.array([-(1 << 50) - 3, (1 << 50) + 7, -1, 0])
    parts = kmeans._limbs(v)
    assert len(parts) == 2 and [sum(int(p[i]) << (kmeans._LIMB * j) for j, p in enumerate(parts)) for i in range(4)] == v.tolist()
