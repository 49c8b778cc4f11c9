"""Camera models and point-spread functions against simulations and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.functions import camera
from spotlattice.operators import imaging, spatial, tracing

AXIS = np.arange(16)
CASES = {"circular": [1.3], "elliptical": [1.2, 1.7], "rotated": [2.0, 1.2, 0.5], "astigmatic": [0.15]}


def test_light_and_bessel():
    assert camera.spot("circular", [0, 500, 8, 8, 1.0], AXIS, AXIS).sum() == pytest.approx(500, abs=1e-3)
    series = lambda x: sum((x / 2) ** (2 * k + 1) / (math.factorial(k) * math.factorial(k + 1)) for k in range(60))
    for x in (0.1, 1.0, 7.0, 20.0):
        assert camera.bessel_i1_scaled(np.array([x]))[0] == pytest.approx(series(x) * math.exp(-x), rel=1e-9)
    assert camera.bessel_i1_scaled(np.array([4999.9]))[0] == pytest.approx(camera.bessel_i1_scaled(np.array([5000.1]))[0], rel=1e-4)


def test_likelihoods():
    assert np.exp(camera.poisson(np.full(60, 7.0), np.arange(60))).sum() == pytest.approx(1)
    c = np.arange(1, 3000) - 0.5
    assert np.exp(camera.multiplied(3.0, 40.0, c)).sum() + math.exp(-3) == pytest.approx(1, abs=1e-3)
    assert camera.poisson_gaussian(np.array([4.0]), np.array([5.0]), 0.0) == pytest.approx(camera.poisson(np.array([4.0]), np.array([5.0])))
    assert camera.corrected(np.array([110.0, 104.0]), np.array([100.0, 100.0]), 2.0).tolist() == [5.0, 2.0]


@pytest.mark.parametrize("kind", CASES)
def test_fits_reach_the_bound(kind):
    true, rng = np.array([3, 2000, 8.3, 7.6, *CASES[kind]]), np.random.default_rng(1)
    expected = camera.spot(kind, true, AXIS, AXIS)
    fits = [imaging.fit_psf(rng.poisson(expected).astype(float), 8, 8, kind) for _ in range(25)]
    found, sd = np.array([p for p, _ in fits]), np.array([s for _, s in fits]).mean(0)
    assert (np.abs(found.mean(0) - true) < np.maximum(1.5 * sd, 0.01)).all()
    spread = found.std(0)
    assert (spread < 2 * sd).all() and (spread > 0.4 * sd).all()


def test_gains(spark):
    rng = np.random.default_rng(3)
    light = rng.gamma(np.maximum(rng.poisson(4, 20000), 1e-9), 50.0)
    values, times = np.unique(np.round(light), return_counts=True)
    photons, gain = camera.fit_multiplied(values, times)
    assert photons == pytest.approx(4, rel=0.05) and gain == pytest.approx(50, rel=0.05)
    rows = [(f, 4, 4, [float(100 + 2.5 * rng.poisson(10 * (k + 1))) for k in range(16)]) for f in range(400)]
    line = imaging.gain_of(imaging.mean_variance(spark.createDataFrame(rows, imaging.FRAME))).first()
    assert line.gain == pytest.approx(2.5, rel=0.15)


def test_fit_shapes(spark):
    true = [camera.spot("elliptical", [2, 3000, 7.0 + f, 8.0, 1.1, 1.6], np.arange(20), np.arange(20)) for f in range(3)]
    rng = np.random.default_rng(2)
    rows = [(f, 20, 20, [float(100 + 2 * v) for v in rng.poisson(img).ravel()]) for f, img in enumerate(true)]
    got = imaging.fit_shapes(spark.createDataFrame(rows, imaging.FRAME), "elliptical", bias=100.0, gain=2.0).orderBy("frame").collect()
    assert [round(r.x) for r in got] == [7, 8, 9] and all(abs(r.shape[0]) == pytest.approx(1.1, abs=0.15) and abs(r.shape[1]) == pytest.approx(1.6, abs=0.2) for r in got)


def test_unmix_channels(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.5, 0.0), (3, 2, 0.2, 0.0), (4, 2, 90.0, 0.0), (5, 0, 0.0, 0.0)], "row_id long, channel int, x double, y double")
    got = {r.row_id: (r.o1, r.o2, r.channel) for r in spatial.unmix_channels(df, 1.0, 0.1, 0.2).collect()}
    assert got == {1: (2, 1, 1), 2: (2, 1, 1), 3: (2, 1, 1), 4: (0, 1, 2)}


def test_threshold_grid(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (3, 5, 0.0, 0.0)], "row_id long, frame int, x double, y double").withColumn("end_frame", F.col("frame"))
    got = {(r.distance, r.memory): (r.traces, r.mean_blinks) for r in tracing.threshold_grid(df, [1.0], [1, 5]).collect()}
    assert got == {(1.0, 1): (2, 1.0), (1.0, 5): (1, 2.0)}
