"""Tracing against a plain version that knows no components, with every option; long steady emitters; counters by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlattice.operators import closest, filters, graph, spatial, tracing


def plain_trace(rows, d, memory, mode="latest", exclusion=0.0, pulse=0, window=0, interval=0):
    """rows: (row_id, frame, end_frame, x, y).  One pass over the frames; all live traces meet all rows of a frame."""
    out, live, last_pulse = {}, [], None  # live: [trace, end, x, y]
    for f in sorted({r[1] for r in rows}):
        closed = interval > 1 and window > 0 and f % interval > window
        if pulse and (f - 1) // pulse != last_pulse:
            live, last_pulse = [], (f - 1) // pulse
        live = [t for t in live if t[1] >= f - memory]
        now = []
        for r in sorted(r for r in rows if r[1] == f):
            near = [math.hypot(t[2] - r[3], t[3] - r[4]) for t in live]
            if exclusion >= d and sum(x <= exclusion for x in near) >= 2 and min(near) <= d:
                out[r[0]] = None if closed else r[0]
            else:
                now.append(r)
        free = [t for t in live if t[1] < f]
        ends = sorted({t[1] for t in free}, reverse=mode == "latest")
        for batch in [free] if mode == "single" or memory == 1 else [[t for t in free if t[1] == e] for e in ends]:
            pairs = sorted((math.hypot(t[2] - r[3], t[3] - r[4]), t[0], r[0]) for t in batch for r in now)
            for dist, t, r in pairs:
                if dist <= d and r in {x[0] for x in now} and any(x[0] == t and x in batch for x in live):
                    row = next(x for x in now if x[0] == r)
                    now.remove(row)
                    old = next(x for x in live if x[0] == t)
                    live.remove(old)
                    batch.remove(old)
                    live.append([t, row[2], row[3], row[4]])
                    out[r] = t
        for r in now:
            out[r[0]] = None if closed else r[0]
            if not closed:
                live.append([r[0], r[2], r[3], r[4]])
    return out


def frames(spark, rows):
    return spark.createDataFrame(rows, "row_id long, frame int, end_frame int, x double, y double").withColumn("intensity", F.lit(1.0))


@pytest.mark.parametrize("options", [{}, {"mode": "earliest"}, {"mode": "single"}, {"pulse": 7}, {"exclusion": 2.5}, {"exclusion": 1.5, "mode": "single"}, {"window": 2, "interval": 6}, {"exclusion": 2.5, "window": 3, "interval": 5, "pulse": 11}])
def test_trace_like_a_plain_one(spark, options):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(260):
        f = int(rng.integers(1, 40))
        rows.append((k, f, f + int(rng.integers(0, 3) if k % 5 == 0 else 0), float(rng.uniform(0, 22)), float(rng.uniform(0, 22))))
    for memory in (1, 4):
        got = {r.row_id: r.trace for r in tracing.trace(frames(spark, rows), 1.5, memory, **options).collect()}
        assert got == plain_trace(rows, 1.5, memory, **options)


def test_excluded_rows_take_no_followers(spark):
    rows = [(1, 1, 1, 0.0, 0.0), (2, 1, 1, 3.0, 0.0), (3, 2, 2, 1.0, 0.0), (4, 3, 3, 1.0, 0.0)]
    got = {r.row_id: r.trace for r in tracing.trace(frames(spark, rows), 1.5, 1, exclusion=3.0).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_ties_go_to_the_smaller_last_row(spark):
    """Row 30 is as far from row 20, in the trace of row 1, as from row 5; the SQL of the queries orders such pairs by rows."""
    rows = [(1, 1, 1, 0.0, 0.0), (20, 2, 2, 0.0, 0.0), (5, 2, 2, 2.0, 0.0), (30, 3, 3, 1.0, 0.0)]
    got = {r.row_id: r.trace for r in tracing.trace(frames(spark, rows), 1.5, 1).collect()}
    assert got == {1: 1, 20: 1, 5: 5, 30: 5}


def test_activation_window(spark):
    rows = [(f, f, f, 100.0 * f, 0.0) for f in range(1, 25)]
    got = {r.row_id: r.trace for r in tracing.trace(frames(spark, rows), 1.0, 2, window=3, interval=10).collect()}
    assert {f for f, t in got.items() if t is None} == {f for f in range(1, 25) if f % 10 > 3}
    starts = tracing.started_at_activation(frames(spark, rows).withColumn("id", F.col("row_id")), 10)
    assert sorted(r.frame for r in starts.collect()) == [1, 11, 21]


def test_a_steady_emitter_makes_few_edges(spark):
    n = 50_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.col("id").cast("int").alias("frame"), F.col("id").cast("int").alias("end_frame"), (F.col("id") % 2 * 0.01).alias("x"), F.lit(0.0).alias("y"))
    assert tracing.chains(df, 1.0, 24).select("component").distinct().count() == 1
    traced = tracing.trace(df.where("row_id < 8000"), 1.0, 24)
    assert traced.select("trace").distinct().count() == 1
    assert tracing.number_traces(traced, df).select("id").distinct().collect()[0][0] == 1


def test_thresholds_share_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(1, 30)), 0, float(rng.uniform(0, 15)), float(rng.uniform(0, 15))) for k in range(200)]
    df = frames(spark, [(a, f, f, x, y) for a, f, _, x, y in rows])
    wide = tracing.trace_components(df, 2.0, 6).select("row_id", "component")
    for d, m in ((0.5, 6), (2.0, 1), (1.0, 3)):
        own = {r.row_id: r.trace for r in tracing.trace(df, d, m).collect()}
        assert own == {r.row_id: r.trace for r in tracing.trace(df, d, m, components=wide).collect()}


def plain_target(rows, d_max, window, lw, ow, decay, gap):
    """rows: (row_id, frame, x, y, intensity).  Assignment by trying all, so frames must be small."""
    level = np.array([r[4] for r in rows])
    m0, s0 = level.mean(), level.std(ddof=1)
    norm = lambda d2, v: math.exp(-d2 / (2 * v)) / math.sqrt(2 * math.pi)
    on = lambda i, m, s: i > m or norm((i - m) ** 2, s * s) > 1 / m
    live, out = [], {}
    for f in sorted({r[1] for r in rows}):
        now = [r for r in rows if r[1] == f]
        live = [t for t in live if f - t[-1][1] - 1 <= gap]

        def cost(t, r, f=f):
            g = f - t[-1][1] - 1
            d2 = (t[-1][2] - r[2]) ** 2 + (t[-1][3] - r[3]) ** 2
            if d2 >= 36 * d_max * (g + 1):
                return math.inf
            p = norm(d2, 4 * d_max * (g + 1))
            if len(t) >= window:
                own = np.mean([((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) / (b[1] - a[1]) for a, b in zip(t[-window:], t[-window + 1 :])])  # noqa: B905
                if own < 4 * d_max:
                    p = (1 - lw) * p + lw * norm(d2, own * (g + 1))
            m, s = state(t)
            return -math.log(p) - math.log(ow * norm((r[4] - m) ** 2, s * s) + (1 - ow) / m) + g / decay

        def state(t):
            m, s, seen = m0, s0, []
            for r in t:
                if on(r[4], m, s):
                    seen.append(r[4])
                if len(seen) >= window:
                    last = np.array(seen[-window:])
                    m, s = (last.mean(), last.std(ddof=1)) if last.std(ddof=1) > 0 else (m0, s0)
            return m, s

        def best(i, free):
            if i == len(live):
                return 0, 0.0, []
            n, c, pairs = best(i + 1, free)
            found = (-n, c, pairs)
            for r in free:
                x = cost(live[i], r)
                if x < math.inf:
                    n, c, pairs = best(i + 1, [y for y in free if y != r])
                    found = min(found, (-(n + 1), c + x, [(i, r), *pairs]), key=lambda z: z[:2])
            return -found[0], found[1], found[2]

        joined = best(0, now)[2]
        for i, r in joined:
            live[i].append(r)
            out[r[0]] = live[i][0][0]
        for r in now:
            if r[0] not in out:
                live.append([r])
                out[r[0]] = r[0]
    return out


def test_multiple_target_like_a_plain_one(spark):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for m in range(3):
        x, y = rng.uniform(0, 4, 2)
        for f in range(1, 30):
            x, y = x + rng.normal(0, 0.15), y + rng.normal(0, 0.15)
            if rng.random() < 0.75:
                rows.append((k, f, float(x), float(y), float(rng.normal(50 + 20 * m, 8))))
                k += 1
    df = spark.createDataFrame(rows, "row_id long, frame int, x double, y double, intensity double")
    got = {r.row_id: r.trace for r in tracing.multiple_target(df, 0.05, window=4, gap=3).collect()}
    assert got == plain_target(rows, 0.05, 4, 0.9, 0.5, 5.0, 3)


def test_hysteresis_modes(spark):
    rows = [(1, 1, 1, 0.0, 0.0), (2, 2, 2, 0.5, 0.0), (3, 3, 3, 1.5, 0.0), (4, 9, 9, 1.5, 0.0), (5, 9, 9, 50.0, 0.0)]
    df = frames(spark, rows).withColumns({"mean_intensity": F.expr("CASE row_id WHEN 1 THEN 30.0 ELSE 12.0 END"), "noise": F.lit(1.0), "v": F.lit(10000.0)})
    kept = lambda distance, memory, **o: sorted(r.row_id for r in tracing.snr_hysteresis(df, 20.0, 10.0, distance, memory, **o).collect())
    assert kept(0.6, 2) == [1, 2] and kept(1.0, 2) == [1, 2, 3] and kept(1.0, 6) == [1, 2, 3, 4]
    assert kept(100.0, 2, distance_mode="nm", nm_per_pixel=100.0) == [1, 2, 3]
    assert kept(1.0, 2, distance_mode="precision", nm_per_pixel=100.0, variance=F.col("v")) == [1, 2, 3]
    assert kept(0.6, 2, distance_mode="precision", nm_per_pixel=100.0, variance=F.col("v")) == [1, 2]
    assert kept(1.0, 300.0, time_mode="time", exposure=50.0) == [1, 2, 3, 4] and kept(1.0, 300.0, time_mode="time") == [1, 2, 3]
    assert kept(0.0, 2) == [1]
    sigma = F.sqrt("v")
    strict = tracing.precision_hysteresis(df.withColumn("v", F.expr("CASE row_id WHEN 1 THEN 100.0 ELSE 400.0 END")), F.col("v"), 10.0, 10.0, 1.0, 2)
    assert sorted(r.row_id for r in strict.collect()) == [1, 2, 3]
    many = tracing.multi_hysteresis(df, [(F.col("mean_intensity"), 20.0, 10.0, False), (sigma, 100.0, 5.0, True)], 1.0, 2)
    assert sorted(r.row_id for r in many.collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        kept(1.0, 2, distance_mode="miles")


HAND = [True, False, True, False, False, True, True, False, False, False, True]


@pytest.mark.parametrize(("options", "want"), [
    ({"kind": "rolling", "allowed": 1, "window": 5}, [0, 2]),
    ({"kind": "rolling", "allowed": 2, "window": 4}, [0, 2]),
    ({"kind": "rolling", "allowed": 2, "window": 3}, [0, 2, 5, 6]),
    ({"kind": "rolling", "allowed": 0, "window": 5}, [0]),
    ({"kind": "consecutive", "allowed": 1}, [0, 2]),
    ({"kind": "consecutive", "allowed": 2}, [0, 2, 5, 6]),
    ({"kind": "pass_rate", "allowed": 2, "rate": 0.5}, [0, 2]),
    ({"kind": "pass_rate", "allowed": 5, "rate": 0.5}, [0, 2, 5, 6]),
    ({"kind": "weighted", "allowed": 2, "fail": 1, "good": 1}, [0, 2, 5, 6]),
    ({"kind": "weighted", "allowed": 3, "fail": 2, "good": 1}, [0, 2]),
])
def test_counters_by_hand(spark, options, want):
    df = spark.createDataFrame([(1, k, g) for k, g in enumerate(HAND)], "frame int, rank int, good boolean")
    assert sorted(r["rank"] for r in filters.fail_count(df, F.col("good"), **options).collect()) == want
    counter, kept = filters.FailCounter(**options), []
    for k, g in enumerate(HAND):
        counter.add(g)
        if not counter.ok():
            break
        kept += [k] * g
    assert kept == want


def test_matches_like_a_plain_one(spark):
    rng = np.random.default_rng(6)
    make = lambda n, at: [(at + k, int(rng.integers(1, 4)), float(round(v, 1)), float(round(w, 1))) for k, (v, w) in enumerate(rng.uniform(0, 12, (n, 2)))]
    a, b = make(120, 0), make(140, 1000)
    b += [(2000 + k, 9, float(2 * k) - 0.01 * k * k, 0.0) for k in range(30)]
    a += [(3000 + k, 9, 2 * k + 1.0, 0.0) for k in range(30)]  # a chain of falling distances
    schema = "row_id long, frame int, x double, y double"
    got = sorted((r.frame, r.a_row_id, r.b_row_id) for r in spatial.match_frames(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 2.0).collect())
    want, used = [], set()
    for d2, i, j, f in sorted(((x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2, x[0], y[0], x[1]) for x in a for y in b if x[1] == y[1]):
        if d2 <= 4.0 and (0, i) not in used and (1, j) not in used:
            used |= {(0, i), (1, j)}
            want.append((f, i, j))
    assert got == sorted(want)


def test_components_by_both_ways(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    df = spark.createDataFrame(edges, "a long, b long")
    both = [sorted(tuple(r) for r in graph.connected_components(df, local=n).collect()) for n in (0, 1 << 20)]
    assert both[0] == both[1] and {c for n, c in both[0] if 1000 <= n < 1200} == {1000} and {c for n, c in both[0] if n >= 2000} == {2000}
    numbers = graph.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k").collect()
    assert sorted((r.k, r.number) for r in numbers) == [(k, k + 1) for k in range(1000)]


def test_shared_tables_leave_no_shuffles(spark):
    import glob
    import time

    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    before = files()
    df = graph.shared_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # files go by messages to the executors
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and df.count() == 7


def test_matches_of_copies_make_few_pairs(spark, monkeypatch):
    """500 copies of a place on both sides are one pair of nodes, not 250,000 pairs; time decides who may match."""
    met, pairs = [], closest._pairs
    monkeypatch.setattr(closest, "_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    place = np.repeat([[0.0], [0.0], [1.0], [1.0]], 500, 1)
    found = closest.matches(np.arange(500)[::-1], place, np.arange(500), place + [[1.0], [0.0], [0.0], [0.0]], 5.0)
    assert sorted((499 - i, j) for i, j, _ in found) == [(k, k) for k in range(500)] and sum(len(m[0]) for m in met) == 1
    assert closest.matches(np.arange(500), place, np.arange(500), place + [[0.0], [0.0], [1.0], [1.0]], 5.0) == []


@pytest.mark.parametrize("grid", [1.0, 0.001])
@pytest.mark.parametrize("few", [1, 8])
def test_closest_like_a_plain_one(monkeypatch, grid, few):
    monkeypatch.setattr(closest, "FEW", few)
    rng = np.random.default_rng(3)
    make = lambda n: (rng.permutation(2 * n)[:n], np.concatenate([np.round(rng.uniform(-6, 6, (2, n)) / grid) * grid, (f := rng.integers(0, 4, n).astype(float))[None], f[None] + rng.integers(0, 2, n)]))
    (ra, a), (rb, b) = make(140), make(110)
    want, used = [], set()
    d2 = (a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2
    common = np.minimum(a[3][:, None], b[3]) - np.maximum(a[2][:, None], b[2]) + 1
    for x, _, _, i, j in sorted((d2[i, j], ra[i], rb[j], i, j) for i in range(140) for j in range(110) if d2[i, j] <= 9 and common[i, j] >= 1):
        if not used & {(0, i), (1, j)}:
            used |= {(0, i), (1, j)}
            want.append((i, j, x))
    assert sorted(closest.matches(ra, a, rb, b, 3.0)) == sorted(want)


def test_match_stores_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "within", None)  # the join whose pairs were stored
    rows = spark.range(300).selectExpr("id AS row_id", "1 AS frame", "0.0D AS x", "0.0D AS y")
    got = spatial.match_frames(rows, rows, 1.0).collect()
    assert sorted((r.a_row_id, r.b_row_id) for r in got) == [(k, k) for k in range(300)]


def test_match_traces_takes_every_trace(spark):
    from spotlattice.plans import catalog

    got = catalog.QUERIES["match_traces"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.a_row_id % 50 for r in got}) == len({r.b_row_id % 50 for r in got}) == 50  # not only each 50th


def test_traces_of_a_place_are_one_row(spark, monkeypatch):
    """300 traces of a place on both sides, and one without an id, reach the task that matches them as two rows."""
    from spotlattice.operators import matching

    seen, groups = [], matching.match_groups
    monkeypatch.setattr(matching, "match_groups", lambda rows, *a: seen.append(rows.count()) or groups(rows, *a))
    rows = lambda at: spark.range(300).selectExpr(f"id + {at} AS id", f"{at} / 1000D AS x", "0.0D AS y", "id % 1 AS frame", "5L AS end_frame").union(spark.sql("SELECT CAST(NULL AS LONG), 0.0D, 0.0D, 0L, 5L"))
    got = sorted(tuple(r) for r in matching.match_traces(rows(0), rows(1000), 2.0).collect())
    assert got == [(k, 1000 + k, 1.0, 6) for k in range(300)] and seen == [2]
