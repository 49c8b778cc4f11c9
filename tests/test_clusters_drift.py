"""Orderings, agglomeration, drift and spot files against plain versions and simulations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.operators import clustering, drift
from spotlattice.sources import formats, tsf


def table(spark, xy, frames=None):
    rows = [(k, int(frames[k]) if frames is not None else 1, float(x), float(y)) for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "row_id long, frame int, x double, y double").withColumn("end_frame", F.col("frame")).withColumn("intensity", F.lit(1.0))


def plain_linkage(xy, d, frames=None, memory=None, particles=False, time=False):
    """All pairs of all clusters, the best joined first."""
    clusters = [[k] for k in range(len(xy))]
    while True:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                p, q = clusters[a], clusters[b]
                if particles and len(p) > 1 and len(q) > 1:
                    continue
                dist = math.dist(np.mean([xy[k] for k in p], 0), np.mean([xy[k] for k in q], 0))
                gap = 0 if frames is None else max(0, min(frames[k] for k in p) - max(frames[k] for k in q), min(frames[k] for k in q) - max(frames[k] for k in p))
                if dist <= d and (memory is None or gap <= memory):
                    key = (gap, dist) if time else (dist, gap)
                    if best is None or key < best[0]:
                        best = (key, a, b)
        if best is None:
            return {frozenset(c) for c in clusters}
        _, a, b = best
        clusters[a] += clusters.pop(b)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.row_id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("case", range(3))
def test_agglomerate_same_as_all_pairs(spark, case):
    rng = np.random.default_rng(case)
    xy, frames = rng.uniform(0, 12, (60, 2)), rng.integers(1, 30, 60)
    assert groups(clustering.agglomerate(table(spark, xy), 1.5)) == plain_linkage(xy, 1.5)
    timed = clustering.agglomerate(table(spark, xy, frames), 1.5, "particle", 8, "time")
    assert groups(timed) == plain_linkage(xy, 1.5, frames, 8, particles=True, time=True)


def test_agglomerate_across_components(spark):
    """The third point is in no reach of the others, but of their centroid."""
    xy = [(0.0, 0.0), (1.0, 0.0), (0.5, 1.05)]
    assert groups(clustering.agglomerate(table(spark, xy), 1.06)) == {frozenset({0, 1, 2})}


def test_agglomerate_edges(spark):
    df = table(spark, [(0.0, 0.0), (0.0, 0.0), (5.0, 5.0)])
    odd = df.union(df.limit(1).select(F.lit(9).cast("long"), "frame", F.lit(None).cast("double"), "y", "end_frame", "intensity"))
    assert groups(clustering.agglomerate(odd, 1.0, "pairwise")) == {frozenset({0, 1}), frozenset({2}), frozenset({9})}
    assert clustering.agglomerate(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        clustering.agglomerate(df, 1.0, "median")


def test_optics_order(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal((0, 0), 0.3, (30, 2)), rng.normal((9, 0), 0.3, (30, 2)), [(4.5, 40.0)]])
    order = clustering.optics(table(spark, xy), 20.0, 5)
    rows = sorted(order.collect(), key=lambda r: (r.component, r.position))
    assert len(rows) == 61 and [r.position for r in rows if r.component == 0] == list(range(60))
    jumps = [r for r in rows if r.reachability is not None and r.reachability > 3]
    assert len(jumps) == 1  # from one cloud to the other
    cut = {r.row_id: r.cluster for r in clustering.cut_ordering(order, 2.0).collect()}
    assert len({cut[k] for k in range(30)}) == len({cut[k] for k in range(30, 60)}) == 1 and cut[0] != cut[30] and cut[60] is None


def test_marker_drift(spark):
    rng = np.random.default_rng(2)
    true = np.column_stack([np.linspace(0, 3, 60), np.sin(np.linspace(0, 3, 60))])
    rows = [(m, f, float(10 * m - true[f, 0] + rng.normal(0, 0.02)), float(5 * m - true[f, 1] + rng.normal(0, 0.02)), 100.0) for m in range(4) for f in range(60) if f % 7 != 3]
    got = {r.frame: (r.dx, r.dy) for r in drift.from_markers(spark.createDataFrame(rows, "marker int, frame int, x double, y double, intensity double"), 0.1).collect()}
    assert sorted(got) == list(range(59))  # the last frame has no marker
    found = np.array([got[f] for f in range(59)])
    off = found - true[:59]
    assert np.abs(off - off.mean(0)).max() < 0.1
    assert drift.from_markers(spark.createDataFrame([], "marker int, frame int, x double, y double, intensity double")).count() == 0


def test_image_shift():
    rng = np.random.default_rng(4)
    img = np.zeros((64, 64))
    img[tuple(rng.integers(20, 44, (2, 30)))] = 1
    assert drift.shift_between(img, np.roll(img, (3, -5), (0, 1))) == pytest.approx((-5, 3), abs=0.3)


def test_image_drift(spark):
    rng = np.random.default_rng(6)
    spots = rng.uniform(20, 44, (25, 2))
    xy = np.concatenate([spots, spots, spots, spots + (4, -2)])
    df = table(spark, xy, np.repeat([0, 1, 2, 3], 25))
    got = {r.block: (r.dx, r.dy) for r in drift.from_images(df, 1, 1.0, 64).collect()}
    assert got[0] == pytest.approx((0, 0), abs=0.5) and got[3] == pytest.approx((-4, 2), abs=0.6)


def test_image_drift_of_rows_beyond_the_size(spark):
    rng = np.random.default_rng(8)
    spots = rng.uniform((-30, 70), (10, 105), (25, 2))  # all outside of 0 to 64
    xy = np.concatenate([spots, spots, spots, spots + (4, -2), [(math.nan, 3.0)]])
    df = table(spark, xy, np.repeat([0, 1, 2, 3, 4], [25, 25, 25, 25, 1]))
    got = {r.block: (r.dx, r.dy) for r in drift.from_images(df, 1, 1.0, 64).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[0] == pytest.approx((0, 0), abs=0.5) and got[3] == pytest.approx((-4, 2), abs=0.6)
    far = spots * 10  # more than ``most`` pixels a side: they get larger
    xy = np.concatenate([far, far, far, far + (40, -20)])
    got = {r.block: (r.dx, r.dy) for r in drift.from_images(table(spark, xy, np.repeat([0, 1, 2, 3], 25)), 1, 1.0, 64, most=100).collect()}
    assert got[0] == pytest.approx((0, 0), abs=5) and got[3] == pytest.approx((-40, 20), abs=6)


def test_frequency_correlation(spark):
    rng = np.random.default_rng(7)
    flat = {r.radius: r.g for r in drift.frequency_correlation(table(spark, rng.uniform(0, 64, (4000, 2))), 1.0, 64, 10).collect()}
    assert all(abs(g - 1) < 0.15 for g in flat.values()) and len(flat) == 10
    centres = rng.uniform(8, 56, (40, 2)).repeat(20, 0)
    close = {r.radius: r.g for r in drift.frequency_correlation(table(spark, centres + rng.normal(0, 1, centres.shape)), 1.0, 64, 10).collect()}
    assert close[1] > 3 and close[1] > close[8]


def test_frequency_correlation_of_all_rows(spark):
    xy = np.random.default_rng(12).uniform((-70, 30), (-10, 110), (3000, 2))  # not square, none of it in 0 to 64
    px = np.floor(xy).astype(int)
    at = {}
    for k in range(1, 6):
        lags = [(i, j) for i in range(-k - 1, k + 2) for j in range(-k - 1, k + 2) if round(math.hypot(i, j)) == k]
        img = np.zeros((80, 60))
        np.add.at(img, (px[:, 1] - 30, px[:, 0] + 70), 1)
        big = np.pad(img, k + 1)
        pairs = [(img * np.roll(big, (j, i), (0, 1))[k + 1 : -k - 1, k + 1 : -k - 1]).sum() / ((60 - abs(i)) * (80 - abs(j))) for i, j in lags]
        at[k] = np.mean(pairs) / img.mean() ** 2
    got = drift.frequency_correlation(table(spark, [*xy, (math.nan, 5.0)]), 1.0, None, 5, window=False).collect()
    assert {r.radius: r.g for r in got} == pytest.approx(at)
    assert drift.frequency_correlation(table(spark, xy).limit(0), 1.0, None, 5).count() == 0
    with pytest.raises(ValueError):
        drift.frequency_correlation(table(spark, xy), 1.0, None, 5, most=70)


def test_spot_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1.5, -2.0, 100.0, None, 3), (7, 9, 0.0, 4.0, 5.0, 0.5, None)], "frame int, end_frame int, x double, y double, intensity double, noise double, category int").withColumn("other", F.lit("a"))
    assert tsf.write(df.repartition(3), str(tmp_path / "t")) == 2
    cols = ["frame", "end_frame", "x", "y", "intensity", "noise", "category"]
    got = sorted(map(tuple, tsf.read(spark, str(tmp_path / "t")).select(cols).collect()))
    assert got == [(1, 2, 1.5, -2.0, 100.0, None, 3), (7, 9, 0.0, 4.0, 5.0, 0.5, None)]
    assert tsf.read(spark, str(tmp_path / "t"), channel=2).count() == 0
    assert tsf.decode(memoryview(tsf.encode(3, "int", -4) + tsf.encode(1500, "double", 2.5))) == {3: -4, 1500: 2.5}


def test_result_files(spark, tmp_path):
    """Files as other tools write them: preamble, units, deviations; short and odd lines are left out."""
    text = "#Results\n#Version Text.V4.D1.E3\n#Id\tFrame\torigX\tError\tX (px)\t+/-\tPrecision (nm)\n3\t1\t7\t0.5\t1.25\t0.1\t20\n4\t2\t8\n5\tx\t7\t0.5\t1.25\t0.1\t20\n"
    (tmp_path / "r.txt").write_text(text)
    df = formats.read_results(spark, str(tmp_path / "r.txt"))
    assert df.columns == ["id", "frame", "orig_x", "error", "x", "x_sd", "precision"]
    assert [tuple(r) for r in df.collect()] == [(3, 1, 7, 0.5, 1.25, 0.1, 20.0)]
    assert formats.result_columns("#Frame\tX (px)")[1] == {"x": "px"}
    (tmp_path / "none.txt").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        formats.read_results(spark, str(tmp_path / "none.txt"))


def test_fan_out(spark, tmp_path):
    df = table(spark, [(1.0, 2.0), (3.0, 4.0)])
    formats.fan_out(df, lambda d: formats.write_malk(d, str(tmp_path / "m")), lambda d: formats.write_columns(d, str(tmp_path / "c"), [("pos", F.col("x") * 2)], " nm"))
    assert sorted(r.x for r in formats.malk(spark, str(tmp_path / "m")).collect()) == [1.0, 3.0]
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).collect()) == ["2.0 nm", "6.0 nm"]


def test_agglomeration_looks_around_only(monkeypatch):
    """A chain of 3,000 rows is one component; a cluster is compared with the few around it, not with all."""
    import pandas as pd

    k = np.arange(3000)
    part = pd.DataFrame({"x": k * 0.4 + 0.001 * (k * 7919 % 97), "y": 0.0, "frame": 1, "end_frame": 1})
    clusters, looked = clustering._Clusters(part, 0.5, None, "distance", False), []
    reach = clusters.reach
    monkeypatch.setattr(clusters, "reach", lambda i: looked.append(len((out := reach(i))[0])) or out)
    clusters.closest()
    assert clusters.live.sum() < 2000 and sum(looked) < 100 * len(k)
