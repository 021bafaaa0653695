"""Exact order statistics against brute force, also with hot values and repartitioned input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martlet.operators import ordered, ranges


@pytest.fixture(scope="module")
def amounts():
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.integers(0, 5_000_000, 400), np.full(250, 1_048_576), rng.integers(-50, 50, 101)])
    return pd.DataFrame({"id": np.arange(len(values)), "g": values % 3, "v": values})


def test_quantiles_match_numpy(spark, amounts):
    df = spark.createDataFrame(amounts)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.8, "e": 1.0}
    got = ordered.exact_quantiles(df, "v", probs).first().asDict()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(amounts.v, p))
    grouped = {r["g"]: r["m"] for r in ordered.exact_quantiles(df.repartition(7), "v", {"m": 0.5}, ["g"]).collect()}
    assert grouped == pytest.approx(amounts.groupby("g").v.median().to_dict())


@pytest.mark.parametrize("descending", [False, True])
def test_row_positions_are_a_total_order(spark, amounts, descending):
    df = spark.createDataFrame(amounts)
    got = ordered.row_positions(df, "v", "id", "at", descending).toPandas()
    want = amounts.sort_values(["v", "id"], ascending=[not descending, True]).reset_index(drop=True)
    got = got.sort_values("at").reset_index(drop=True)
    assert list(got["at"]) == list(range(1, len(want) + 1))
    assert list(got["id"]) == list(want["id"])


@pytest.mark.parametrize("key", ["long", "string"])
def test_row_positions_keep_rows_without_value_or_key(spark, key):
    df = spark.createDataFrame([("1", 5), ("2", None), (None, 5), (None, None)], "id string, v long").withColumn("id", F.col("id").cast(key))
    up = {(r.v, r.id and int(r.id)): r.at for r in ordered.row_positions(df, "v", "id", "at").collect()}
    assert up == {(None, None): 1, (None, 2): 2, (5, None): 3, (5, 1): 4}
    down = {(r.v, r.id and int(r.id)): (r.at, r.at_total) for r in ordered.row_positions(df, "v", "id", "at", True).collect()}
    assert down == {(5, None): (1, 4), (5, 1): (2, 4), (None, None): (3, 4), (None, 2): (4, 4)}


@pytest.mark.parametrize("tiles", [5, 10])
def test_tile_slices_split_like_ntile(spark, amounts, tiles):
    df = spark.createDataFrame(amounts)
    got = ordered.tile_slices(ordered.histogram(df, "v"), "v", tiles, descending=True).groupBy("tile").agg(
        F.sum("in_tile").alias("n"), F.sum(F.col("v") * F.col("in_tile")).alias("s")).orderBy("tile").toPandas()
    parts = np.array_split(np.sort(amounts.v.to_numpy())[::-1], tiles)
    assert list(got.n) == [len(p) for p in parts]
    assert list(got.s) == [int(p.sum()) for p in parts]


def test_ntile_at_with_fewer_rows_than_tiles(spark):
    df = spark.range(1, 4).select(ordered.ntile_at(F.col("id"), F.lit(3).cast("bigint"), 5).alias("t"))
    assert [r.t for r in df.orderBy("t").collect()] == [1, 2, 3]


def test_share_curve_matches_sorted_cumulative_sum(spark, amounts):
    positive = amounts[amounts.v > 0]
    row = ordered.share_curve(spark.createDataFrame(positive), "v", [1, 20, 50]).first()
    cum = np.cumsum(np.sort(positive.v.to_numpy())[::-1]) / positive.v.sum() * 100
    assert row["rows_for_80pct"] == min((cum <= 80).sum() + 1, len(cum))
    for q in (1, 20, 50):
        assert row[f"share_{q}"] == pytest.approx(cum[max(len(cum) * q // 100, 1) - 1])


def test_string_keys_order(spark):
    rows = [(f"{k:08x}", 5 if k % 2 else 9) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, v bigint")
    got = [r.id for r in ordered.row_positions(df, "v", "id", "at").orderBy("at").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]


def _keyed(kind):
    """(id, v): ids with a long common prefix, sparse 64-bit ids, or plain ones; one value, few, many, and NULLs."""
    rng = np.random.default_rng(11)
    n = 3000
    ids = {"prefix": [f"customer-00000000-{k:07d}" for k in rng.permutation(n)], "sparse": [int(k) * 3_000_000_000_000_007 - 2**62 for k in rng.permutation(n)],
           "plain": [int(k) for k in rng.permutation(n)]}
    return {"one": [(i, 7) for i in ids[kind]], "few": [(i, int(v)) for i, v in zip(ids[kind], rng.choice([5, 5, 5, 9, -2, 10**12], n))],
            "nulls": [(None if k % 50 == 0 else i, None if k % 3 == 0 else int(v)) for k, (i, v) in enumerate(zip(ids[kind], rng.integers(0, 40, n)))]}


@pytest.mark.parametrize("kind", ["prefix", "sparse", "plain"])
@pytest.mark.parametrize("values", ["one", "few", "nulls"])
@pytest.mark.parametrize("descending", [False, True])
def test_positions_by_ranges(spark, monkeypatch, kind, values, descending):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 300)
    rows = [(*r, k) for k, r in enumerate(_keyed(kind)[values])]
    df = spark.createDataFrame(rows, f"id {'string' if kind == 'prefix' else 'long'}, v long, c long").repartition(5)
    got = ranges.positions(df, "v", "id", "at", descending, {"run": F.col("c")}).collect()
    value = lambda r: ((r[1] is None, -(r[1] or 0)) if descending else (r[1] is not None, r[1] or 0))
    want = sorted(rows, key=lambda r: (*value(r), r[0] is not None, r[0] or ("" if kind == "prefix" else 0)))
    assert [r["at"] for r in sorted(got, key=lambda r: r["at"])] == list(range(1, len(rows) + 1))
    placed = {r["at"]: r for r in got}
    before = [value(r) for r in want]
    firsts = {}
    for i, v in enumerate(before):
        firsts.setdefault(v, i)
    total = sum(r[2] for r in rows)
    for i, r in enumerate(want):
        mine = placed[i + 1]
        assert (mine["id"], mine["v"], mine["at_before"], mine["at_total"], mine["run_total"]) == (r[0], r[1], firsts[before[i]], len(rows), total)
    assert np.cumsum([placed[i + 1]["c"] for i in range(len(rows))]).tolist() == [placed[i + 1]["run"] for i in range(len(rows))]
    ordered_rows = df.withColumns(ranges.order_columns("v", "id", descending))
    sizes = [r["n"] for r in ordered_rows.groupBy(ranges.range_of(ordered_rows, ranges.cut_points(ordered_rows, len(rows))).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 300


def test_positions_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(f"k{i % 7}", i % 5 if i % 4 else None) for i in range(60)], "id string, v long").distinct()
    few = df.orderBy("id", "v").limit(9).collect()
    for descending in (False, True):
        all_at = {(r["id"], r["v"]): r["at"] for r in ranges.positions(df, "v", "id", "at", descending).collect()}
        assert df.agg(F.array(*ranges.positions_of(df, few, "v", "id", descending)).alias("p")).first()["p"] == [all_at[r["id"], r["v"]] for r in few]
    assert ranges.positions(df.limit(0), "v", "id", "at", sums={"s": F.col("v")}).count() == 0
