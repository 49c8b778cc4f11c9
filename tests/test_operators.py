"""State machines, fits and formats against plain versions and simulations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotlattice.functions import fits
from spotlattice.functions import localisation as fn
from spotlattice.operators import aggregates, filters, imaging, spatial, tracing, tracks
from spotlattice.sources import formats
from spotlattice.streaming import frames


def locs(spark, rows, columns="row_id long, frame int, x double, y double"):
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("end_frame", F.col("frame")).withColumn("intensity", F.lit(1.0))


def test_trace_moving_molecules(spark):
    rng = np.random.default_rng(3)
    rows, truth, k = [], {}, 0
    for m in range(20):
        x, y = 100.0 * (m % 5), 100.0 * (m // 5)
        for f in range(1, 30):
            x, y = x + rng.uniform(-0.5, 0.5), y + rng.uniform(-0.5, 0.5)
            if rng.random() < 0.8:
                rows.append((k, f, x, y))
                truth[k] = m
                k += 1
    got = {r.row_id: r.trace for r in tracing.trace(locs(spark, rows), 5.0, 10).collect()}
    assert len(got) == len(rows) and len(set(got.values())) == 20
    assert len({(truth[r], t) for r, t in got.items()}) == 20


def test_trace_edges(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 4, 0.0, 0.0), (3, 8, 0.0, 0.0), (4, 1, 0.0, 9.0)]
    of = lambda **k: {r.row_id: r.trace for r in tracing.trace(locs(spark, rows), 1.0, **k).collect()}
    assert of(memory=3) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert of(memory=4) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert of(memory=0) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert of(memory=4, pulse=4) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert tracing.trace(locs(spark, rows).limit(0), 1.0, 3).count() == 0


def test_trace_modes(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 2, 3.0, 0.0), (3, 3, 1.4, 0.0)]  # nearer to the older tail
    of = lambda mode: {r.row_id: r.trace for r in tracing.trace(locs(spark, rows), 2.0, 5, mode=mode).collect()}[3]
    assert (of("latest"), of("earliest"), of("single")) == (2, 1, 1)


def test_hysteresis(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 2, 0.1, 0.0), (3, 1, 50.0, 0.0)]
    df = locs(spark, rows).withColumn("v", F.expr("CASE row_id WHEN 1 THEN 9 WHEN 2 THEN 5 ELSE 5 END"))
    assert sorted(r.row_id for r in tracing.hysteresis(df, F.col("v") > 8, F.col("v") > 4, 1.0, 2).collect()) == [1, 2]


def test_multiple_target(spark):
    rows = [(10 * m + f, f, 30.0 * m + 0.1 * f, 0.0) for m in range(3) for f in range(1, 9)]
    got = {r.row_id: r.trace for r in tracing.multiple_target(locs(spark, rows), 0.1, gap=2).collect()}
    assert {(r // 10, t) for r, t in got.items()} == {(m, 10 * m + 1) for m in range(3)}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 5, 2))
        cost = rng.random((n, m))
        pairs = tracing.assignment(cost)
        best = min(sum(cost[a, b] for a, b in zip(p, q, strict=True)) for p in itertools.combinations(range(n), min(n, m)) for q in itertools.permutations(range(m), min(n, m)))
        assert sum(cost[a, b] for a, b in pairs) == pytest.approx(best)


@pytest.mark.parametrize("kind", ["consecutive", "pass_rate", "rolling", "weighted", "resetting"])
def test_fail_counters(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(f, k, bool(rng.random() < 0.4)) for f in range(6) for k in range(15)]
    df = spark.createDataFrame(rows, "frame int, rank int, good boolean")
    options = {"kind": kind, "allowed": 2, "rate": 0.4}
    got = sorted((r.frame, r["rank"]) for r in filters.fail_count(df, F.col("good"), **options).collect())
    want = []
    for f in range(6):
        c = filters.FailCounter(**options)
        for _, k, good in [r for r in rows if r[0] == f]:
            c.add(good)
            if not c.ok():
                break
            if good:
                want.append((f, k))
    assert got == want


def test_fail_counters_that_reset_or_combine(spark):
    rows = [(1, k, good) for k, good in enumerate([True, False, False, True, False, False, True, False, True])]
    df = spark.createDataFrame(rows, "frame int, rank int, good boolean")
    kept = lambda **o: [r["rank"] for r in filters.fail_count(df, F.col("good"), **o).orderBy("rank").collect()]
    assert kept(kind="resetting", allowed=2, reset=0.5) == [0, 3]  # failures 1, 2, then 1, 2, 3
    assert kept(kind="resetting", allowed=3, reset=0.5) == [0, 3, 6, 8]
    short, long = {"kind": "consecutive", "allowed": 1}, {"kind": "resetting", "allowed": 2, "reset": 0.5}
    assert kept(kind="and", parts=(short, long)) == [0] and kept(kind="or", parts=(short, long)) == [0, 3]
    assert kept(kind="null") == [0, 3, 6, 8]
    for wrong in ({"kind": "restting"}, {"kind": "and"}, {"kind": "resetting", "reset": 2.0}):
        with pytest.raises(ValueError):
            filters.fail_count(df, F.col("good"), **wrong)


def test_render_by_block_keeps_every_row(spark):
    df = locs(spark, [(k, 40 * k, k * 0.37, k * 0.21) for k in range(30)]).withColumn("block", F.floor(F.col("frame") / 100))
    for weighted in (False, True):
        got = aggregates.render(df, 3.0, weighted=weighted, on=("block",)).groupBy("block").agg(F.sum("value").alias("v")).collect()
        assert {r.block: r.v for r in got} == pytest.approx({b: sum(1 for k in range(30) if 40 * k // 100 == b) for b in range(12)})


def test_pair_correlation_without_a_box(spark):
    xy = np.random.default_rng(3).uniform((-40, 100), (40, 150), (300, 2))
    df = locs(spark, [(k, 1, float(x), float(y)) for k, (x, y) in enumerate(xy)])
    low, high = xy.min(0) + 5, xy.max(0) - 5
    centres = np.flatnonzero(((xy >= low) & (xy <= high)).all(1))
    d = np.hypot(*(xy[centres][:, None] - xy[None]).transpose(2, 0, 1))
    d[np.arange(len(centres)), centres] = np.inf
    want = {k: int(((d >= k) & (d < k + 1)).sum()) for k in range(5)}
    got = spatial.pair_correlation(df, 5.0, 1.0).collect()
    assert {r.ring: r.pairs for r in got} == want
    assert {r.ring: r.g for r in got} == pytest.approx({k: n / (len(centres) * np.pi * (2 * k + 1)) for k, n in want.items()})
    with pytest.raises(ValueError):
        spatial.pair_correlation(df, 30.0, 1.0)
    assert spatial.pair_correlation(df.where("row_id < 0"), 5.0, 1.0).count() == 0


def test_match_is_one_to_one(spark):
    rng = np.random.default_rng(2)
    a = locs(spark, [(k, int(k % 3), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 20, (60, 2)))])
    b = locs(spark, [(k, int(k % 3), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 20, (60, 2)))])
    m = spatial.match_frames(a, b, 3.0).collect()
    assert len({r.a_row_id for r in m}) == len({r.b_row_id for r in m}) == len(m) > 10
    assert all(r.distance <= 3 for r in m)


def test_bucketed_join_is_exact(spark):
    xy = np.random.default_rng(4).uniform(-20, 20, (150, 2))
    df = locs(spark, [(k, 1, float(x), float(y)) for k, (x, y) in enumerate(xy)])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    assert spatial.within(df, df, 3.0).count() == (d2 <= 9).sum()


def test_local_density_of_one(spark):
    assert spatial.local_density(locs(spark, [(1, 1, 5.5, 5.5)]), 1).first().density == pytest.approx(1 / 9)


def test_off_and_on_times(spark):
    df = locs(spark, [(1, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (3, 5, 0.0, 0.0)]).withColumn("id", F.lit(1))
    assert tuple(tracks.blinks(df).first()) == (1, 2, 3, 2)
    assert tracks.blinks(df.limit(0)).count() == 0


def test_spec_and_polygon(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.0), (2.0, 2.0, 0.0), (0.0, None, 1.0)], "x double, y double, z double")
    assert df.where(filters.in_polygon(F.col("x"), F.col("y"), [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])).count() == 1
    assert df.where(filters.from_spec({"not": {"box": [0, 1, 0, 1]}})).count() == 1


def test_mle_integral_matches_steps(spark):
    row = spark.range(1).select(fn.mle_variance(F.lit(100.0), F.lit(130.0), F.lit(500.0), F.lit(9.0)).alias("v")).first()
    sa2 = 130.0**2 + 100.0**2 / 12
    rho = 2 * np.pi * sa2 * 9 / (500 * 100**2)
    x = (np.arange(2_000_000) + 0.5) / 2_000_000
    assert row.v == pytest.approx(sa2 / 500 / -(x * np.log(x) / (x + rho)).mean(), rel=1e-5)


def test_fits_recover_simulations():
    rng = np.random.default_rng(1)
    jumps = np.concatenate([rng.exponential(0.4, 6000), rng.exponential(8.0, 4000)])
    found = fits.jump_distances(jumps, 4)
    assert len(found) == 2 and found[0][0] == pytest.approx(0.1, rel=0.1) and found[1][1] == pytest.approx(0.4, abs=0.05)
    t = rng.geometric(1 - np.exp(-0.2), 20000) - 1
    assert fits.residence(dict(zip(*map(lambda v: v.tolist(), np.unique(t, return_counts=True)), strict=True)), 1)["rates"][0] == pytest.approx(0.2, rel=0.05)
    x = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(8, 1, (300, 2))])
    label = fits.gaussian_mixture(x, 2)["label"]
    assert len(set(label[:300])) == len(set(label[300:])) == 1
    best, value = fits.evolve(lambda p: -((p - 0.3) ** 2).sum(1), np.zeros(2), np.ones(2))
    assert value > -1e-3
    counts = {k: 100 * (1 + 2 * np.exp((1 - k) / 3)) for k in range(1, 12)}
    assert fits.blinking(counts, 11)["blinking_rate"] == pytest.approx(3, rel=0.02)


def test_spots_are_found_and_fitted(spark):
    images, truth = imaging.simulate(spark, 6, spots=1)
    fitted = imaging.fit_frames(images).toPandas().groupby("frame").first()
    want = truth.toPandas().set_index("frame")
    assert len(fitted) == 6
    assert np.hypot(fitted.x - want.x, fitted.y - want.y).max() < 0.5
    assert (fitted.intensity / 800).between(0.7, 1.3).all()


def test_plateaus_of_wide_frames_give_their_first_pixels():
    def plain(img, n):
        p = np.pad(img, n, constant_values=-np.inf)
        top = np.lib.stride_tricks.sliding_window_view(p, (2 * n + 1, 2 * n + 1)).max(axis=(2, 3))
        out = []
        for y, x in np.argwhere(img >= top):
            if not any(abs(x - a) <= n and abs(y - b) <= n for a, b, _ in out):
                out.append((x, y, img[y, x]))
        return sorted(out, key=lambda s: -s[2])

    flat, noisy = np.zeros((40, 256)), np.random.default_rng(9).normal(0, 1, (24, 2048))
    noisy[9:15, 1000:1006] = 50.0
    assert len(imaging.maxima(flat, 2)) == 14 * 86  # one in each square of side n + 1
    assert imaging.maxima(noisy, 2) == plain(noisy, 2)
    assert [(x, y) for x, y, v in imaging.maxima(noisy, 2) if v == 50.0] == [(x, y) for y in (9, 12) for x in (1000, 1003)]


def test_smoothing_keeps_flat_images():
    flat = np.full((9, 9), 3.0)
    for kind, f in imaging.SMOOTHERS.items():
        assert np.allclose(f(flat, 1), 3.0), kind
    assert imaging.ring_correlation(np.eye(32), np.eye(32))[1:].min() > 0.99


def test_render_keeps_the_sum(spark):
    df = locs(spark, [(k, 1, k * 0.37, k * 0.21) for k in range(30)])
    for weighted in (False, True):
        assert aggregates.render(df, 3.0, weighted=weighted).agg(F.sum("value")).first()[0] == pytest.approx(30)


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n1\t2.5\t3.5\t7\nbad\tline\n2\t1.0\t1.0\t8\n")
    got = formats.delimited(spark, str(tmp_path / "a.txt"), {"frame": 0, "x": 1, "y": 2, "intensity": 3}).collect()
    assert [(r.frame, r.x) for r in got] == [(1, 2.5), (2, 1.0)]
    (tmp_path / "m.txt").write_text("1.5 2.5 3 400\n1.0 2.0 4 500\n")
    assert formats.sniff(spark, str(tmp_path / "m.txt")) == "malk"
    assert formats.malk(spark, str(tmp_path / "m.txt")).agg(F.sum("frame")).first()[0] == 7
    (tmp_path / "r.txt").write_text("\n".join(["<localizations />"] * 12))
    with pytest.raises(ValueError):
        formats.rapidstorm(spark, str(tmp_path / "r.txt"))
    (tmp_path / "c.csv").write_text("1,1,2\n1,1,3\n")
    with pytest.raises(ValueError):
        formats.categories(spark, str(tmp_path / "c.csv"))
    (tmp_path / "n.txt").write_text("Channel Name\tXc\tYc\tArea\tWidth\tAxial ratio\tBG\tFrame\tLength\nA\t1\t2\t100\t4\t0.5\t3\t5\t2\n")
    r = formats.nstorm(spark, str(tmp_path / "n.txt")).first()
    assert (r.frame, r.end_frame, r.sx * r.sy) == (5, 6, pytest.approx(4.0))


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(k, k % 2, 1 + 3 * (k // 2) + 50 * (k // 10), 10.0 * (k % 2), 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, "row_id long, region long, frame int, x double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = frames.trace(source, 1.0, 5).writeStream.format("memory").queryName("traces").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.row_id: r.trace for r in spark.table("traces").collect()}
    batch = {r.row_id: r.trace for r in tracing.trace(df.withColumn("end_frame", F.col("frame")), 1.0, 5).collect()}
    assert got == batch
    timed = frames.with_time(source.withColumn("intensity", F.lit(1.0)), 1000.0)
    q = frames.tumbling(timed, "10 seconds").writeStream.format("memory").queryName("blocks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("blocks").agg(F.sum("n")).first()[0] == 20


def test_registry(spark):
    formats.register(pd_frame(spark), "held")
    assert formats.resolve(spark, "held", 2.0).first().x == 2.0


def pd_frame(spark):
    return spark.createDataFrame(pd.DataFrame({"x": [1.0], "y": [2.0]}))
