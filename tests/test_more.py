"""Functions that no query reaches: thresholds of ring correlation, temporal medians, neighbours, exports, small solvers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.functions import fits
from spotlattice.functions import localisation as fn
from spotlattice.operators import clustering, filters, imaging, sorting, spatial, tracks
from spotlattice.sources import formats


def test_threshold_curves():
    assert imaging.threshold_curve("1/7", 5) == pytest.approx([1 / 7] * 5)
    half = imaging.threshold_curve("0.5-bit", 50)
    n = 2 * math.pi * np.arange(1, 50)
    assert half[0] == 1 and half[1:] == pytest.approx((0.2071 + 1.9102 / np.sqrt(n)) / (1.2071 + 0.9102 / np.sqrt(n)), abs=1e-4)
    one = imaging.threshold_curve("1-bit", 50)
    assert one[1:] == pytest.approx((0.5 + 2.4142 / np.sqrt(n)) / (1.5 + 1.4142 / np.sqrt(n)), abs=1e-4)
    assert imaging.threshold_curve("3-sigma", 4) == pytest.approx([3 * math.sqrt(2), *(3 / np.sqrt(math.pi * np.arange(1, 4)))])
    with pytest.raises(ValueError):
        imaging.threshold_curve("2-apples", 4)


def test_crossings():
    falling = np.linspace(1, 0, 11)
    assert imaging.crossing(falling) == pytest.approx((1 - 1 / 7) * 10) and imaging.crossing(np.ones(8)) == math.inf
    curve = np.array([1.0, 0.99, 0.99, 0.99, 0.99, 0.98, 0.97, 0.9, 0.5, 0.1, 0.0, 0.0])
    assert 7 < imaging.crossing(curve, "2-sigma") < 10


def test_temporal_median(spark):
    rng = np.random.default_rng(2)
    rows = [(0, k % 2, f, float(v)) for k in range(2) for f, v in enumerate(rng.normal(size=20))]
    got = {(r.iy, r.frame): r.value for r in tracks.temporal_median(spark.createDataFrame(rows, "ix int, iy int, frame int, value double"), 3).collect()}
    for k in (0, 1):
        v = [r[3] for r in rows if r[1] == k]
        assert all(got[k, f] == pytest.approx(float(np.median(v[max(0, f - 3) : f + 4]))) for f in range(20))


def test_neighbours(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 5.0), (2, 2, 2, 0.5, 0.0, 9.0), (3, 3, 3, 0.0, 0.5, 9.0), (4, 2, 2, 9.0, 0.0, 99.0), (5, 9, 9, 0.0, 0.0, 50.0)]
    df = spark.createDataFrame(rows, "row_id long, frame int, end_frame int, x double, y double, intensity double")
    got = {r.row_id: (r.neighbour, round(r.distance, 6)) for r in spatial.neighbours(df, 1.0, 2).collect()}
    assert got == {1: (2, 0.5), 2: (3, round(math.sqrt(0.5), 6)), 3: (2, round(math.sqrt(0.5), 6))}


def test_exports(spark, tmp_path):
    rows = [(1, 1, 1, 0.0, 0.0), (2, 2, 1, 1.0, 0.0), (3, 9, 1, 1.0, 1.0), (4, 10, 1, 1.5, 1.0), (5, 3, 2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "row_id long, frame int, id long, x double, y double").withColumn("end_frame", F.col("frame"))
    formats.export_tracks(df, str(tmp_path / "a"), "spoton", 2, 0.05, 0.1)
    a = spark.read.csv(str(tmp_path / "a"), header=True, inferSchema=True).orderBy("frame").collect()
    assert [(r.frame, r.t, r.trajectory, r.x) for r in a] == [(1, 0.05, 1, 0.0), (2, 0.1, 1, 0.1), (9, 0.45, 1, 0.1), (10, 0.5, 1, pytest.approx(0.15))]
    formats.export_tracks(df, str(tmp_path / "b"), "vbspt", 2, max_gap=3)
    b = spark.read.csv(str(tmp_path / "b"), header=True, inferSchema=True).collect()
    assert sorted(r.id for r in b) == [1, 1, 2, 2]


def test_crlb_precision_lets_rows_without_deviations_pass(spark):
    df = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.5, 0.5), (3, None, 0.1)], "row_id long, sdx double, sdy double")
    assert sorted(r.row_id for r in df.where(filters.precision_crlb(0.2)).collect()) == [1, 3]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(fn.cdf2d(fn.inverse_cdf2d(F.lit(0.4)))) == pytest.approx(0.4)
    assert value(fn.mean_signal_of_share(F.lit(10.0), F.lit(1.0), F.lit(2.0), 0.5)) == pytest.approx(value(fn.mean_signal(F.lit(10.0), F.lit(1.0), F.lit(2.0), math.sqrt(2 * math.log(2)))))
    assert fn.angle_factor("DEGREE", "RADIAN") == pytest.approx(math.pi / 180) and fn.time_factor("FRAME", "SECOND", 50.0) == pytest.approx(0.05)
    mix = [[1.0, 0.1, 0.05], [0.2, 1.0, 0.1], [0.0, 0.3, 1.0]]
    seen = np.array(mix) @ [3.0, 2.0, 1.0]
    assert [value(c) for c in fn.unmix3([F.lit(float(v)) for v in seen], mix)] == pytest.approx([3.0, 2.0, 1.0])
    assert value(spatial.erf(F.lit(0.7))) == pytest.approx(math.erf(0.7), abs=2e-7)
    assert value(fn.precision_by("local_background", F.lit(100.0), F.lit(130.0), F.lit(500.0), background=F.lit(9.0))) == pytest.approx(value(F.sqrt(fn.lse_variance(F.lit(100.0), F.lit(130.0), F.lit(500.0), F.lit(9.0)))))
    assert value(fn.mle_variance(F.lit(100.0), F.lit(130.0), F.lit(500.0), F.lit(9.0), emccd=True)) == pytest.approx(2 * value(fn.mle_variance(F.lit(100.0), F.lit(130.0), F.lit(500.0), F.lit(9.0))))
    with pytest.raises(ValueError):
        fn.precision_by("guess", F.lit(1.0), F.lit(1.0), F.lit(1.0))


def test_lags_from_the_origin(spark):
    df = spark.createDataFrame([(k, k, 1, float(k), 0.0) for k in range(5)], "row_id long, frame int, id long, x double, y double")
    got = {r.lag: (r.msd, r.n) for r in tracks.msd_by_lag(df, 3, from_origin=True).collect()}
    assert got == {1: (1.0, 1), 2: (4.0, 1), 3: (9.0, 1)}


def test_orders(spark):
    df = spark.createDataFrame([(1, 2, 2, 5.0, 7), (2, 1, 4, 5.0, 9), (3, 1, 1, 8.0, 3), (4, 1, 1, 5.0, 1)], "row_id long, frame int, end_frame int, intensity double, id int")
    of = lambda order: [r.row_id for r in sorting.sorted_rows(df, order).collect()]
    assert of("frame") == [3, 4, 2, 1] and of("frame_id") == [4, 3, 2, 1] and of("id_frame") == [4, 3, 1, 2] and of("end") == [3, 4, 1, 2]
    assert [r.k for r in sorting.numbered_by(df).orderBy("row_id").collect()] == [4, 3, 1, 2]
    assert sorted(r.row_id for r in sorting.shuffled(df, 1).collect()) == [1, 2, 3, 4]


def test_weighted_jumps_as_repeated_ones():
    rng = np.random.default_rng(1)
    jumps = np.round(np.concatenate([rng.exponential(0.4, 3000), rng.exponential(8.0, 2000)]), 2)
    values, counts = np.unique(jumps[jumps > 0], return_counts=True)
    a, b = fits.jump_distances(jumps, 3), fits.jump_distances(values, 3, counts=counts)
    assert np.allclose(np.array(a), np.array(b), rtol=0.02)


def test_particle_single_linkage_like_a_plain_one(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(round(x, 1)), float(round(y, 1))) for k, (x, y) in enumerate(rng.uniform(0, 25, (150, 2)))]
    pairs = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, a[0], b[0]) for a in rows for b in rows if a[0] < b[0])
    cluster = {}
    for d2, a, b in pairs:
        if d2 <= 4.0 and not (a in cluster and b in cluster):
            home = cluster.get(a) or cluster.get(b) or set()
            home |= {a, b}
            cluster[a] = cluster[b] = home
    want = {k: min(cluster.get(k, {k})) for k, _, _ in rows}
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    assert {r.row_id: r.cluster for r in clustering.particle_single_linkage(df, 2.0).collect()} == want
    timed = df.withColumns({"frame": F.lit(1), "end_frame": F.lit(1)})
    same = [sorted(map(tuple, clustering.agglomerate(timed, 1.0, m).collect())) for m in ("centroid", "pairwise_without_neighbours")]
    assert same[0] == same[1]


def test_residence_models():
    rng = np.random.default_rng(3)
    histogram = lambda t: dict(zip(*(v.tolist() for v in np.unique(t, return_counts=True)), strict=True))
    one = histogram(rng.geometric(1 - np.exp(-0.2), 4000) - 1)
    two = histogram(np.concatenate([rng.geometric(1 - np.exp(-0.05), 4000), rng.geometric(1 - np.exp(-1.0), 4000)]) - 1)
    assert len(fits.residence_choice(one)["rates"]) == 1 and len(fits.residence_choice(two)["rates"]) == 2
    ends = fits.residence_bootstrap(one, 1, repeats=30)
    assert ends["rates"][0][0] < 0.2 < ends["rates"][0][1] and ends["fractions"][0] == (1.0, 1.0)
    assert fits.residence_likelihood(two, fits.residence(two, 2)) > fits.residence_likelihood(two, fits.residence(two, 1))


def test_lines_and_sizes():
    t = np.arange(1.0, 6.0)
    assert fits.msd_line(t, 4 * 0.3 * t + 0.1) == (pytest.approx(0.3), pytest.approx(0.1)) and fits.msd_line(t, 4 * 0.3 * t, True) == (pytest.approx(0.3), 0.0)
    rng = np.random.default_rng(5)
    sizes = rng.binomial(6, 0.4, 20000)
    n, p = fits.binomial_sizes({k: int((sizes == k).sum()) for k in range(1, 7)}, 8)
    assert n == 6 and p == pytest.approx(0.4, abs=0.02)


def test_single_linkage_of_crowded_cells(spark):
    rng = np.random.default_rng(4)
    xy = np.round(np.vstack([rng.uniform(0, 30, (150, 2)), rng.normal(10, 0.3, (150, 2))]), 1)
    rows = [(int(k) * 7 % 1000, float(x), float(y)) for k, (x, y) in enumerate(xy)]
    up = {r[0]: r[0] for r in rows}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in rows:
        for b in rows:
            if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1.0:
                p, q = sorted((top(a[0]), top(b[0])))
                up[q] = p
    df = spark.createDataFrame([*rows, (5000, None, 1.0)], "row_id long, x double, y double")
    assert {r.row_id: r.cluster for r in spatial.single_linkage(df, 1.0).collect()} == {r[0]: top(r[0]) for r in rows} | {5000: 5000}
