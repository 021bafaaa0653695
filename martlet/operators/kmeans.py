"""K-Means for many numbers of clusters and many starts at once: one scan of the points serves every fit.

A step assigns each point to the nearest centre of every fit that still moves, in one pass that adds up counts, sums and
squares by (fit, cluster). Only those sums reach the driver, so its part depends on the fits, not on the points. Features
are whole numbers of 2^-20, so every sum is exact: a fit is the same for any partitioning and after a lost executor.

Starts follow k-means++: the next centre is drawn with a chance in proportion to the squared distance from those chosen. The
draw takes the largest of log(u) / distance, u a hash of point, seed and round, so it is one maximum over all points; and the
first k centres of a seed are its start for k, so the starts of all fits take as many passes as the largest k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features are rounded to multiples of 1 / UNIT.
UNIT = 1 << 20
#: Points per block of distances, per matrix product of a step and per exact sum in doubles; bits of a part of such a sum.
_ROWS, _STEP, _BATCH, _LIMB = 4096, 1024, 1 << 14, 38


@dataclass
class Fit:
    """One start of one k: centres (in units), the clusters' counts, sums and square sums, and how the steps went."""

    k: int
    seed: int
    centres: np.ndarray
    steps: int = 0
    converged: bool = False
    n: list[int] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)
    squares: list[int] = field(default_factory=list)

    @property
    def inertia(self) -> float:
        """Squared distances to the clusters' means, from exact sums."""
        within = sum((Fraction(q) - Fraction(sum(s * s for s in sums), n) for n, sums, q in zip(self.n, self.sums, self.squares) if n), Fraction(0))
        return float(within / UNIT**2)

    @property
    def between(self) -> float:
        """Squared distances of the clusters' means from the mean of all points, each as often as it has points."""
        total, whole = sum(self.n), [sum(c) for c in zip(*self.sums)]
        apart = sum((Fraction(sum(s * s for s in sums), n) for n, sums in zip(self.n, self.sums) if n), Fraction(0))
        return float((apart - Fraction(sum(s * s for s in whole), total)) / UNIT**2) if total else 0.0


def point(features: Sequence[Column]) -> Column:
    """Features as an array in units. A missing feature (NULL or NaN) counts as zero."""
    return F.array(*[F.round(F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) * UNIT).cast("bigint") for c in features])


def point_frame(rows: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """key, _hash and _x (the point of its features)."""
    return rows.select(key, F.xxhash64(key).alias("_hash"), point([F.col(c) for c in features]).alias("_x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("_x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def dealt(points: DataFrame) -> DataFrame:
    """Points dealt to all cores, whatever the partitions of the rows they were made of; at most about 2^18 a task."""
    cores, rows = points.sparkSession.sparkContext.defaultParallelism, points.count()
    return points.select("_hash", "_x").repartition(max(cores, -(-rows // (1 << 18))), "_hash")


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each point from each centre, term by term, so a point's value does not depend on the rows around it."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def _uniform(hashes: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each point, by seed and round."""
    z = hashes.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1342543DE82EF95 + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def starts(points: DataFrame, seeds: Sequence[int], most: int) -> dict[int, np.ndarray]:
    """Up to `most` distinct starting points for each seed, in the order in which they were drawn."""
    chosen: dict[int, list] = {s: [] for s in seeds}
    schema = "seed long, score double, hash long, x array<bigint>"
    for turn in range(most):

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for piece in _pieces(batches):
                x, hashes = _matrix(piece), piece.column(piece.schema.get_field_index("_hash")).to_numpy()
                for seed, centres in chosen.items():
                    if len(centres) < turn:
                        continue
                    weight = squared_distances(x, np.array(centres)).min(axis=1) if turn else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        score = np.where(weight > 0, np.log(_uniform(hashes, seed, turn)) / weight, -np.inf)
                    i = int(np.lexsort((hashes, -score))[0])
                    if score[i] > -np.inf and (seed not in best or (-score[i], hashes[i]) < best[seed][:2]):
                        best[seed] = (-score[i], int(hashes[i]), x[i].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array([-b[0] for b in best.values()], pa.float64()), pa.array([b[1] for b in best.values()], pa.int64()),
                                              pa.array([b[2] for b in best.values()], pa.list_(pa.int64()))], names=["seed", "score", "hash", "x"])

        drawn = points.select("_hash", "_x").mapInArrow(draw, schema).groupBy("seed").agg(F.max_by("x", F.struct("score", -F.col("hash"))).alias("x"))
        for row in drawn.collect():
            chosen[row["seed"]].append(row["x"])
    return {s: np.array(c, dtype=np.float64) for s, c in chosen.items()}


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles v0 + v1 * 2^_LIMB + ..., each so small that sums over _BATCH rows are exact."""
    out = []
    while values.size and max(-int(values.min()), int(values.max())) >= 1 << _LIMB:
        out.append((values & ((1 << _LIMB) - 1)).astype(np.float64))
        values = values >> _LIMB
    return [*out, values.astype(np.float64)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For centres (cluster, fit, feature) and points: whether (cluster, fit, point) is the point's nearest, exactly one per fit.

    Distances come from one matrix product for all fits. Where its rounding could settle the choice, the distances are
    taken term by term, so the result is that of `squared_distances` and the same for any rows around the point.
    """
    k, fits, width = centres.shape
    points, norms = x.astype(np.float64), (centres * centres).sum(axis=2)
    apart = (-2 * centres.reshape(k * fits, width) @ points.T).reshape(k, fits, len(x)) + norms[:, :, None]
    near = apart <= apart.min(axis=0) + 2.0**-45 * ((points * points).sum(axis=1) + norms.max())
    if np.count_nonzero(near) > fits * len(x):
        close = near.sum(axis=0) > 1
        for f in np.flatnonzero(close.any(axis=1)):
            rows = np.flatnonzero(close[f])
            near[:, f, rows] = squared_distances(x[rows], centres[:, f]).argmin(axis=1) == np.arange(k)[:, None]
    return near


def _sums(points: DataFrame, fits: Sequence[Fit]) -> None:
    """One pass: counts, sums and square sums of every fit's clusters by its present centres."""
    alike: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        alike.setdefault(len(f.centres), []).append(i)
    groups = [(members, np.stack([fits[i].centres for i in members], axis=1)) for members in alike.values()]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [0] * len(groups)
        for batch in _pieces(batches, _BATCH):
            x = _matrix(batch)
            square = (x.astype(object) ** 2).sum(axis=1) if np.abs(x).max() >= 1 << 29 else (x * x).sum(axis=1)
            parts = [_limbs(v) for v in (np.ones(len(x), np.int64), square, *x.T)]
            side = np.stack([limb for part in parts for limb in part], axis=1)
            for g, (_, centres) in enumerate(groups):
                k, n_fits, _ = centres.shape
                added: np.ndarray = np.zeros((k * n_fits, side.shape[1]))
                for start in range(0, len(x), _STEP):
                    near = _nearest(x[start:start + _STEP], centres)
                    added += near.reshape(k * n_fits, -1).astype(np.float64) @ side[start:start + _STEP]
                limbs = iter(added.astype(np.int64).astype(object).T)
                total[g] = total[g] + np.stack([sum(next(limbs) << (_LIMB * j) for j in range(len(part))) for part in parts], axis=1)
        rows = [(members[at % len(members)], at // len(members), j, v) for (members, _), sums in zip(groups, total) if not isinstance(sums, int)
                for at, row in enumerate(sums.tolist()) if row[0] for j, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32()) for c in range(3)] + [pa.array([Decimal(r[3]) for r in rows], pa.decimal128(38, 0))], names=["fit", "cluster", "at", "value"])

    added = points.select("_x").mapInArrow(tally, "fit int, cluster int, at int, value decimal(38,0)").groupBy("fit", "cluster", "at").agg(F.sum("value").alias("value"))
    values = {(r["fit"], r["cluster"], r["at"]): int(r["value"]) for r in added.collect()}
    for i, f in enumerate(fits):
        width = f.centres.shape[1]
        f.n, f.squares = ([values.get((i, c, at), 0) for c in range(len(f.centres))] for at in (0, 1))
        f.sums = [[values.get((i, c, 2 + j), 0) for j in range(width)] for c in range(len(f.centres))]


def fit_many(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], tolerance: float = 1e-6, most_steps: int = 300) -> list[Fit]:
    """Every (k, seed), each to its own end: no centre moves by more than `tolerance`, or `most_steps` (then not converged).

    A cluster that loses all its points keeps its centre. Where there are fewer distinct points than k, the fit has one
    centre for each. No points, no fits.
    """
    begun = starts(points, seeds, max(ks))
    fits = [Fit(k, s, begun[s][:k].copy()) for k in ks for s in seeds if len(begun[s])]
    moving = list(fits)
    while moving:
        _sums(points, moving)
        for f in moving:
            new = np.array([[v / n for v in sums] if n else old.tolist() for n, sums, old in zip(f.n, f.sums, f.centres)])
            moved = np.sqrt(((new - f.centres) ** 2).sum(axis=1)).max() / UNIT
            f.steps += 1
            f.converged = bool(moved <= tolerance)
            if not f.converged and f.steps < most_steps:
                f.centres = new
        moving = [f for f in moving if not f.converged and f.steps < most_steps]
    return fits


def best_fits(fits: Sequence[Fit]) -> list[Fit]:
    """The fit of least inertia for each k, the smallest seed on a tie."""
    return [min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.seed)) for k in sorted({f.k for f in fits})]


def silhouettes(points: DataFrame, fits: Sequence[Fit]) -> list[float]:
    """The mean silhouette (squared Euclidean) of each fit over all points, in one pass.

    The mean distance to a cluster follows from its count, sum and square sum; a point alone in its cluster counts zero.
    """
    kept = [[c for c in range(len(f.n)) if f.n[c]] for f in fits]
    stats = [(f.centres, np.array(f.n, dtype=np.float64), np.array([[v / UNIT for v in s] for s in f.sums]), np.array([q / UNIT**2 for q in f.squares]), np.array(k)) for f, k in zip(fits, kept)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(stats)
        for piece in _pieces(batches):
            units = _matrix(piece)
            x = units / UNIT
            square = (x * x).sum(axis=1)
            for i, (centres, n, sums, q, some) in enumerate(stats):
                own = squared_distances(units, centres).argmin(axis=1)
                mean = square[:, None] - 2 * (x @ sums.T) / np.maximum(n, 1) + q / np.maximum(n, 1)
                row = np.arange(len(x))
                inside = mean[row, own] * n[own] / np.maximum(n[own] - 1, 1)
                others = np.full_like(mean, np.inf)
                others[:, some] = mean[:, some]
                others[row, own] = np.inf
                outside = others.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(inside < outside, 1 - inside / outside, np.where(inside > outside, outside / inside - 1, 0.0))
                s = np.where((n[own] > 1) & np.isfinite(outside), s, 0.0)
                total[i] += int(np.rint(s * 2.0**40).astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["fit", "value"])

    added = {r["fit"]: int(r["value"]) for r in points.select("_x").mapInArrow(judge, "fit int, value decimal(38,0)").groupBy("fit").agg(F.sum("value").alias("value")).collect()}
    return [added[i] / 2.0**40 / sum(f.n) for i, f in enumerate(fits)]


def nearest(fit: Fit, x: Column) -> Column:
    """The number of the centre nearest to a point ``x`` (array in units); clusters are numbered by falling size, then by centre."""
    order = sorted(range(len(fit.centres)), key=lambda c: (-fit.n[c], fit.centres[c].tolist()))
    number = np.argsort(order).tolist()

    def apart(centre: np.ndarray) -> Column:
        terms = [F.get(x, F.lit(j)).cast("double") - F.lit(float(c)) for j, c in enumerate(centre)]
        return reduce(add, [t * t for t in terms])

    distances = F.array(*[apart(c) for c in fit.centres])
    return F.element_at(F.array(*[F.lit(n).cast("bigint") for n in number]), F.array_position(distances, F.array_min(distances)).cast("int"))


def assign(points: DataFrame, fit: Fit, key: str, out: str = "cluster") -> DataFrame:
    """key and the number of the nearest centre."""
    return points.select(key, nearest(fit, F.col("_x")).alias(out))
