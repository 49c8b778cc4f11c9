"""The library's queries by name, with the SQL that gives the same rows where there is one.

Floating-point results are rounded in both, since sums may run in another order; the digits leave no halves to round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import localisation as fn
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import clustering, drift, imaging, matching, sorting, spatial, tracing, tracks
from ..operators.graph import numbered, shared_table
from ..sources import formats, records, tiff, tsf
from ..streaming import frames as streams
from .tables import EV, LOC, PT, localisations, points, read, stream_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, table: Callable[[SparkSession, str], DataFrame] = localisations):
    """Registers a function of one table under its own name."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query(LOC + "SELECT row_id, frame, round(x * 107, 9) AS x, round(y * 107, 9) AS y, round(intensity / 2.5, 9) AS intensity, round(noise / 2.5, 9) AS noise FROM loc")
def project_units(df):
    d, i = fn.distance_factor("PIXEL", "NM", 107.0), fn.intensity_factor("COUNT", "PHOTON", 2.5)
    return rounded(df.select("row_id", "frame", (F.col("x") * d).alias("x"), (F.col("y") * d).alias("y"), (F.col("intensity") * i).alias("intensity"), (F.col("noise") * i).alias("noise")))


@query(LOC + "SELECT row_id, round(intensity / (2 * pi() * sx * sy), 9) AS height, round(sqrt(abs(sx * sy)), 9) AS width, round(CASE WHEN noise = 0 THEN 0 ELSE mean_intensity / noise END, 9) AS snr, round(sqrt((1 - exp(-sx * sx / 2))), 9) AS root_cdf FROM loc")
def project_shape(df):
    return rounded(df.select("row_id", fn.height().alias("height"), fn.width().alias("width"), fn.snr().alias("snr"), F.sqrt(fn.cdf2d("sx")).alias("root_cdf")))


@query(LOC + "SELECT row_id, round((130 * 130 + 10000 / 12.0) / intensity * (1.7777777778 + 25.13274123 * (130 * 130 + 10000 / 12.0) * noise * noise / (intensity * 10000)), 6) AS variance FROM loc")
def lse_precision(df):
    return rounded(df.select("row_id", fn.lse_variance(F.lit(100.0), F.lit(130.0), "intensity", F.col("noise") * F.col("noise")).alias("variance")), 6)


_MLE = "(130 * 130 + 10000 / 12.0)"


@query(LOC + f", r AS (SELECT row_number() OVER () AS rn, row_id, intensity, noise, 2 * pi() * {_MLE} * noise * noise / (intensity * 10000) AS rho FROM loc), t(u, c) AS (VALUES " + ", ".join(f"({u!r}::DOUBLE, {c!r}::DOUBLE)" for u, c in fn.mle_terms()) + f"), i AS (SELECT any_value(row_id) AS row_id, any_value(intensity) AS n, CASE WHEN any_value(rho) = 0 THEN 1 ELSE -sum(c / (u + rho)) END AS i1 FROM r, t GROUP BY rn) SELECT row_id, round({_MLE} / n / i1, 6) AS variance FROM i")
def mle_precision(df):
    return rounded(df.select("row_id", fn.mle_variance(F.lit(100.0), F.lit(130.0), F.col("intensity"), F.col("noise") * F.col("noise")).alias("variance")), 6)


@query(LOC + f", v AS (SELECT row_id, precision AS stored, CASE WHEN intensity <= 0 THEN NULL ELSE sqrt(2 * {_MLE} / intensity * (1.7777777778 + 25.13274123 * {_MLE} * noise * noise / 2 / (intensity * 10000))) END AS p FROM loc) SELECT row_id, round(coalesce(CASE WHEN stored > 0 THEN stored END, p), 9) AS precision, CASE WHEN stored > 0 THEN 'stored' ELSE 'noise' END AS source FROM v")
def best_precision(df):
    """The stored precision, or else that of noise with an electron-multiplying gain."""
    p, source = fn.best_precision(["stored", "noise"], F.lit(100.0), F.lit(130.0), F.col("intensity"), emccd=True)
    return rounded(df.select("row_id", p.alias("precision"), source.alias("source")))


@query(LOC + "SELECT row_id, round(intensity * 0.5 / (pi() * -2 * ln(0.5) * sx * sy), 9) AS p05, round(intensity * (1 - exp(-0.5)) / (pi() * sx * sy), 9) AS r1, round(x + 3.5, 9) AS x, round(y - 2, 9) AS y FROM loc")
def mean_signals(df):
    x, y = fn.translated("x", "y", 3.5, -2.0)
    return rounded(df.select("row_id", fn.mean_signal_of_share("intensity", "sx", "sy", 0.5).alias("p05"), fn.mean_signal("intensity", "sx", "sy", 1.0).alias("r1"), x.alias("x"), y.alias("y")))


@query(LOC + "SELECT row_id, CASE WHEN background = 0 THEN 5.0 ELSE background END AS background, greatest(abs(floor(x) + 0.5 - x), abs(floor(y) + 0.5 - y)) AS drift FROM loc")
def fill_background(df):
    drift = F.greatest(F.abs(F.floor("x") + 0.5 - F.col("x")), F.abs(F.floor("y") + 0.5 - F.col("y")))
    return df.select("row_id", F.when(F.col("background") == 0, 5.0).otherwise(F.col("background")).alias("background"), drift.alias("drift"))


@query(LOC + "SELECT row_id, CASE WHEN category = 0 THEN -row_number() OVER (PARTITION BY category ORDER BY row_id) ELSE category END AS id FROM loc")
def assign_zero_ids(df):
    """Unique negative ids for rows without one; ranks in parts by range, so that no task holds all of them."""
    zero = numbered(df.where("category = 0").select("row_id"), "row_id", name="k")
    return zero.select("row_id", (-F.col("k")).alias("id")).union(df.where("category <> 0").select("row_id", F.col("category").cast("long")))


@query(LOC + "SELECT row_id, frame, row_number() OVER (ORDER BY frame, intensity DESC, end_frame, row_id) AS k FROM loc")
def sort_results(df):
    """The sort of result tables, as a numbering: by frame, brightest first, then end frame."""
    return sorting.numbered_by(df.select("row_id", "frame", "end_frame", "intensity", "id"), "frame").select("row_id", "frame", F.col("k"))


@query(EV + "SELECT row_id, row_number() OVER (ORDER BY id, frame, row_id) AS by_id, row_number() OVER (ORDER BY frame, id, row_id) AS by_frame, row_number() OVER (ORDER BY frame, row_id) AS by_end FROM ev", stream_rows)
def sort_orders(df):
    rows = df.select("row_id", "frame", "end_frame", "intensity", "id")
    named = lambda order, name: sorting.numbered_by(rows, order).select("row_id", F.col("k").alias(name))
    return named("id_frame", "by_id").join(named("frame_id", "by_frame"), "row_id").join(named("end", "by_end"), "row_id")


@query(LOC + "SELECT category AS id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM loc WHERE category > 0 GROUP BY category")
def ids_to_traces(df):
    return tracing.ids_to_traces(df.withColumn("id", F.col("category"))).drop("row_ids").withColumn("n", F.col("n").cast("long"))


@query(LOC + "SELECT row_id FROM loc WHERE id IN (SELECT id FROM loc GROUP BY id HAVING min(frame) % 7 = 1)")
def started_at_activation(df):
    return tracing.started_at_activation(df, 7).select("row_id")


@query(LOC + "SELECT row_id, unnest(generate_series(frame, end_frame)) AS frame FROM loc")
def expand_frames(df):
    return tracks.expand_frames(df).select("row_id", "frame")


@query(LOC + "SELECT row_id, CAST(3 + (frame - 1) + 2 * floor((frame - 1) / 5.0) AS INT) AS frame FROM loc")
def resequence_frames(df):
    return df.select("row_id", fn.resequence("frame", 3, 5, 2).alias("frame"))


@query(LOC + ", t AS (SELECT frame, avg(x) AS dx, avg(y) AS dy FROM loc WHERE frame % 3 = 0 GROUP BY frame) SELECT row_id, round(x + coalesce(dx, 0), 9) AS x, round(y + coalesce(dy, 0), 9) AS y FROM loc LEFT JOIN t USING (frame)")
def drift_apply(df):
    drift = df.where("frame % 3 = 0").groupBy("frame").agg(F.avg("x").alias("dx"), F.avg("y").alias("dy"))
    return rounded(flt.apply_drift(df.select("row_id", "frame", "x", "y"), drift).select("row_id", "x", "y"))


@query(LOC + "SELECT row_id, round((x - 0.2 * y) / (1 - 0.02), 9) AS d1, round(y - 0.1 * ((x - 0.2 * y) / (1 - 0.02)), 9) AS d2 FROM loc")
def crosstalk_unmix(df):
    d1, d2 = fn.unmix2("x", "y", 0.1, 0.2)
    return rounded(df.select("row_id", d1.alias("d1"), d2.alias("d2")))


@query(LOC + "SELECT row_id, sha256(concat_ws('|', CAST(row_id AS VARCHAR), CAST(frame AS VARCHAR), CAST(id AS VARCHAR), coalesce(CAST(category AS VARCHAR), '~'))) AS digest FROM loc")
def row_digest(df):
    return df.select("row_id", fn.row_digest("row_id", "frame", "id", "category").alias("digest"))


# --- predicates ---------------------------------------------------------------------------------------------------------


@query(LOC + "SELECT row_id FROM loc WHERE (CASE WHEN noise = 0 THEN 0 ELSE mean_intensity / noise END) >= 100 AND sqrt(abs(sx * sy)) BETWEEN 1.02 AND 1.3 AND intensity >= 20000 AND abs(x) <= 40 AND abs(y) <= 40 AND (130 * 130 + 10000 / 12.0) / intensity * (1.7777777778 + 25.13274123 * (130 * 130 + 10000 / 12.0) * noise * noise / (intensity * 10000)) <= 4")
def filter_multi(df):
    variance = fn.lse_variance(F.lit(100.0), F.lit(130.0), "intensity", F.col("noise") * F.col("noise"))
    return df.where(flt.multi(100, 1.0, 1.3, 1.02, variance, 2.0, 40.0, 20000)).select("row_id")


@query(LOC + "SELECT row_id FROM loc WHERE noise <= 0 OR intensity / (2 * pi() * sx * sy) / noise >= 1000")
def filter_anr(df):
    return df.where(flt.anr(1000)).select("row_id")


@query(LOC + "SELECT row_id FROM loc WHERE CASE WHEN background > 0 THEN mean_intensity / sqrt(background) ELSE CASE WHEN noise = 0 THEN 0 ELSE mean_intensity / noise END END >= 200")
def filter_sbr(df):
    return df.where(flt.sbr(200)).select("row_id")


@query(LOC + "SELECT row_id FROM loc WHERE (intensity >= 30000 OR NOT (z BETWEEN 0.02 AND 0.08)) AND x BETWEEN 5 AND 45 AND y BETWEEN 0 AND 60")
def filter_spec(df):
    return df.where(flt.from_spec({"and": [{"or": [{"signal": [30000]}, {"not": {"depth": [0.02, 0.08]}}]}, {"box": [5, 45, 0, 60]}]})).select("row_id")


@query(LOC + "SELECT row_id FROM loc WHERE x * x + y * y <= 900 AND sx * sy BETWEEN 1.0201 AND 1.21")
def filter_euclid_width(df):
    return df.where(flt.every(flt.euclid_shift(1, 1, 30), flt.xy_width_range(1, 1, 1.01, 1.1))).select("row_id")


@query(LOC + "SELECT row_id, x - 10 AS x, y - 5 AS y FROM loc WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 45")
def crop_rectangle(df):
    return flt.crop(df, 10, 5, 20, 40, reset=True).select("row_id", "x", "y")


@query(LOC + "SELECT row_id FROM loc WHERE x >= 0 AND x <= 40 AND y > 0 AND y <= 40 AND x + y < 40 AND x >= 0")
def crop_polygon(df):
    return df.where(flt.in_polygon(F.col("x"), F.col("y"), [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0)])).select("row_id")


@query(LOC + "SELECT category, CASE WHEN intensity > 30000 THEN 'kept' ELSE 'rejected' END AS side, count(*) AS n FROM loc GROUP BY ALL")
def filter_split(df):
    kept, rejected = flt.split_modes(df, F.col("intensity") > 30000)
    both = kept.withColumn("side", F.lit("kept")).unionByName(rejected.withColumn("side", F.lit("rejected")))
    return both.groupBy("category", "side").agg(F.count("*").alias("n"))


@query(LOC + ", m AS (SELECT DISTINCT CAST(trunc(x) AS INT) AS ix, CAST(trunc(y) AS INT) AS iy, CAST((trunc(x) + trunc(y)) % 5 AS INT) AS label FROM loc WHERE CAST(trunc(x) AS INT) % 2 = 0) SELECT row_id, coalesce(label, 0) AS label FROM loc LEFT JOIN m ON ix = CAST(trunc(x) AS INT) AND iy = CAST(trunc(y) AS INT)")
def split_by_mask(df):
    pixel = df.select(F.col("x").cast("int").alias("ix"), F.col("y").cast("int").alias("iy")).where("ix % 2 = 0").distinct()
    return flt.by_mask(df, pixel.withColumn("label", ((F.col("ix") + F.col("iy")) % 5).cast("int"))).select("row_id", "label")


@query(LOC + ", r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY intensity DESC, row_id) AS k FROM loc), a AS (SELECT *, k - coalesce(max(CASE WHEN noise <= 5 THEN k END) OVER (PARTITION BY frame ORDER BY k), 0) AS run FROM r), b AS (SELECT *, max(run) OVER (PARTITION BY frame ORDER BY k) AS longest FROM a) SELECT row_id FROM b WHERE noise <= 5 AND longest <= 2")
def fail_count_consecutive(df):
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("intensity"), "row_id")))
    return flt.fail_count(ranked, F.col("noise") <= 5, allowed=2).select("row_id")


_RANKED = LOC + ", r AS (SELECT row_id, frame, noise <= 5 AS good, row_number() OVER (PARTITION BY frame ORDER BY intensity DESC, row_id) AS k FROM loc)"
_STANDS = " SELECT row_id FROM (SELECT row_id, good, bool_and(h) OVER (PARTITION BY frame ORDER BY k) AS every FROM h) WHERE good AND every"


def _ranked(df: DataFrame) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("intensity"), "row_id")))
    return ranked.select("row_id", "frame", "rank", "noise")


@query(_RANKED + ", h AS (SELECT *, k <= 3 OR sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY k) >= 0.5 * k AS h FROM r)" + _STANDS)
def fail_count_pass_rate(df):
    return flt.fail_count(_ranked(df), F.col("noise") <= 5, kind="pass_rate", allowed=3, rate=0.5).select("row_id")


@query(_RANKED + ", h AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY frame ORDER BY k ROWS 5 PRECEDING) <= 2 AS h FROM r)" + _STANDS)
def fail_count_rolling(df):
    return flt.fail_count(_ranked(df), F.col("noise") <= 5, kind="rolling", allowed=2, window=6).select("row_id")


@query(_RANKED.replace("WITH", "WITH RECURSIVE", 1) + ", c AS (SELECT row_id, frame, good, k, CASE WHEN good THEN 0 ELSE 2 END AS score FROM r WHERE k = 1 UNION ALL SELECT r.row_id, r.frame, r.good, r.k, CASE WHEN r.good THEN greatest(0, c.score - 1) ELSE c.score + 2 END FROM c JOIN r ON r.frame = c.frame AND r.k = c.k + 1), h AS (SELECT *, score <= 3 AS h FROM c)" + _STANDS)
def fail_count_weighted(df):
    return flt.fail_count(_ranked(df), F.col("noise") <= 5, kind="weighted", allowed=3, fail=2, good=1).select("row_id")


@query(LOC + ", j AS (SELECT id, frame, x, y, frame - lag(frame) OVER w AS gap, (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS d2 FROM loc WINDOW w AS (PARTITION BY id ORDER BY frame, row_id)), t AS (SELECT id, max(frame) - min(frame) AS length, CASE WHEN sum(gap) > 0 THEN sum(greatest(0, d2 - 4 * 0.25) * (2 / (2 - 1 / 3.0))) / sum(gap) / 4 END AS d FROM j GROUP BY id) SELECT row_id FROM loc WHERE id IN (SELECT id FROM t WHERE d BETWEEN 0.5 AND 5 AND length >= 10)")
def filter_molecules(df):
    good = tracks.track_diffusion(df, 0.5).where("d BETWEEN 0.5 AND 5 AND length >= 10").select("id")
    return df.join(good, "id", "left_semi").select("row_id")


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query(LOC + "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM loc")
def data_bounds(df):
    return agg.bounds(df)


@query(LOC + "SELECT bool_or(noise > 0) AS has_noise, bool_or(mean_intensity > 0) AS has_intensity, bool_or(background <> 0) AS has_background, bool_or(category IS NOT NULL AND category <> 0) AS has_category, bool_or(end_frame <> frame) AS has_end_frame, bool_or(z <> 0) AS has_3d, bool_and(precision IS NOT NULL) AS has_precision, count(DISTINCT CASE WHEN id <> 0 THEN id END) > 1 AS has_multiple_id FROM loc")
def attribute_flags(df):
    return agg.flags(df)


@query(LOC + ", s AS (SELECT *, CASE WHEN noise = 0 THEN 0 ELSE mean_intensity / noise END AS snr FROM loc) SELECT dataset, count(*) AS n, max(frame) AS max_frame, round(max(frame) * 50.0 / 1000, 9) AS seconds, round(avg(snr), 9) AS mean_snr, round(quantile_cont(snr, 0.5), 9) AS median_snr, round(min(snr), 9) AS min_snr, round(max(snr), 9) AS max_snr, round(avg(precision), 9) AS mean_precision, round(quantile_cont(precision, 0.5), 9) AS median_precision, round(min(precision), 9) AS min_precision, round(max(precision), 9) AS max_precision, round(min(x), 9) AS min_x, round(max(x), 9) AS max_x, round(min(y), 9) AS min_y, round(max(y), 9) AS max_y, bool_or(z <> 0) AS is_3d FROM s GROUP BY dataset")
def dataset_summary(df):
    return rounded(agg.summary(df, 50.0))


@query(LOC + "SELECT id, count(*) AS n, round(sum(intensity), 3) AS signal, round(sum(x * intensity) / sum(intensity), 9) AS cx, round(sum(y * intensity) / sum(intensity), 9) AS cy, round(CASE WHEN count(*) > 1 THEN sqrt(var_samp(x) + var_samp(y)) ELSE 0 END, 9) AS sd FROM loc GROUP BY id")
def cluster_stats(df):
    return rounded(agg.clusters(df, weighted=True).withColumn("signal", F.round("signal", 3)))


@query(LOC + ", p AS (SELECT *, CASE WHEN precision > 0 THEN precision ELSE 1 END AS p FROM loc), c AS (SELECT id, count(*) AS n, max(p) AS own, sum(intensity * x) / sum(intensity) AS cx, sum(intensity * y) / sum(intensity) AS cy FROM p GROUP BY id), d AS (SELECT p.id, any_value(n) AS n, any_value(own) AS own, sqrt((sum(intensity * (x - cx) * (x - cx)) + sum(intensity * p * p)) / sum(intensity) / 2) AS vx, sqrt((sum(intensity * (y - cy) * (y - cy)) + sum(intensity * p * p)) / sum(intensity) / 2) AS vy FROM p JOIN c ON p.id = c.id GROUP BY p.id) SELECT id, n, round(CASE WHEN n = 1 THEN own ELSE greatest(vx, vy) END, 6) AS precision FROM d")
def cluster_precision(df):
    return rounded(agg.weighted_precision(df), 6)


@query(LOC + ", j AS (SELECT id, (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS d2 FROM loc WINDOW w AS (PARTITION BY id ORDER BY frame, row_id)) SELECT id, count(*) AS n, round(avg(d2), 9) AS msd, round(avg(sqrt(d2)), 9) AS mean_distance FROM j GROUP BY id")
def msd_adjacent(df):
    return rounded(tracks.adjacent_msd(df))


_BLINK = ", j AS (SELECT id, frame, frame - lag(frame) OVER (PARTITION BY id ORDER BY frame, row_id) AS gap FROM {t})"


@query(LOC + _BLINK.format(t="loc") + " SELECT id, 1 + sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS n_blinks, count(DISTINCT frame) AS t_on, sum(CASE WHEN gap > 1 THEN gap - 1 ELSE 0 END) AS t_off FROM j GROUP BY id")
def blinks(df):
    return tracks.blinks(df)


@query(EV + _BLINK.format(t="ev") + ", b AS (SELECT id, count(*) AS n, 1 + sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS n_blinks, sum(CASE WHEN gap > 1 THEN gap - 1 ELSE 0 END) AS t_off FROM j GROUP BY id) SELECT n_blinks, count(*) AS tracks, sum(n) AS rows_, sum(t_off) AS t_off FROM b GROUP BY n_blinks", stream_rows)
def track_summary(df):
    """Flagship: tracks by number of blinks."""
    per = tracks.with_jumps(df).groupBy("id").agg(F.count("*").alias("n"), (1 + F.sum(F.when(F.col("gap") > 1, 1).otherwise(0))).alias("n_blinks"), F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1).otherwise(0)).alias("t_off"))
    return per.groupBy("n_blinks").agg(F.count("*").alias("tracks"), F.sum("n").alias("rows_"), F.sum("t_off").alias("t_off"))


@query(LOC + "SELECT id, round(avg(background), 9) AS background, round(sqrt(sum(noise * noise)), 9) AS noise, round(sum(intensity), 3) AS intensity, min(frame) AS frame, max(end_frame) AS end_frame, round(avg(x), 9) AS x, round(avg(y), 9) AS y, count(*) AS n FROM loc GROUP BY id")
def centroid_dataset(df):
    return rounded(agg.centroids(df).withColumn("intensity", F.round("intensity", 3)))


@query(LOC + _BLINK.format(t="loc") + ", o AS (SELECT gap - 1 AS t_off, count(*) AS n FROM j WHERE gap > 1 GROUP BY 1) SELECT t_off, n, round(100 * sum(n) OVER (ORDER BY t_off) / sum(n) OVER (), 9) AS percent FROM o")
def dark_time_cdf(df):
    return rounded(tracks.dark_time_cdf(df))


@query(LOC + _BLINK.format(t="loc") + ", t AS (SELECT max(frame) - min(frame) - 1 AS t, count(*) AS n, min(gap) AS g FROM j GROUP BY id) SELECT t, count(*) AS n FROM t WHERE n >= 2 AND coalesce(g > 0, true) AND t >= 0 GROUP BY t")
def residence_histogram(df):
    return tracks.residence_times(df, 2)


@query(LOC + "SELECT frame, count(*) AS n FROM loc GROUP BY frame")
def activation_counts(df):
    return df.groupBy("frame").agg(F.count("*").alias("n"))


@query(LOC + ", c AS (SELECT category, sum(CASE WHEN orig_value <> 0 AND noise <= 4 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN orig_value = 0 AND noise <= 4 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN orig_value = 0 AND noise > 4 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN orig_value <> 0 AND noise > 4 THEN 1 ELSE 0 END) AS fn FROM loc GROUP BY category), d AS (SELECT category, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn FROM c) SELECT category, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fp + fn), 6) AS jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM d")
def match_metrics(df):
    scored = agg.match_metrics(agg.classification(df, F.col("noise") <= 4, ["category"]))
    return rounded(scored.select("category", "recall", "precision", "jaccard", "mcc", "accuracy"), 6)


@query(LOC + ", c AS (SELECT category AS a, CAST(noise AS INT) AS b, CAST(count(*) AS DOUBLE) AS n FROM loc GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM c), sa AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY a)), sb AS (SELECT sum(m * (m - 1) / 2) AS v FROM (SELECT sum(n) AS m FROM c GROUP BY b)) SELECT round((s.n * (s.n - 1) / 2 + 2 * both_ - sa.v - sb.v) / (s.n * (s.n - 1) / 2), 6) AS rand, round((both_ - sa.v * sb.v / (s.n * (s.n - 1) / 2)) / ((sa.v + sb.v) / 2 - sa.v * sb.v / (s.n * (s.n - 1) / 2)), 6) AS adjusted_rand FROM s, sa, sb")
def rand_index(df):
    return rounded(agg.rand_index(df.select("category", F.col("noise").cast("int").alias("level")), "category", "level"), 6)


@query(LOC + "SELECT CAST(round(sqrt(x * x + y * y)) AS INT) AS radius, round(avg(intensity) + 3e-7, 5) AS mean, round(stddev_samp(intensity) / sqrt(count(*)) + 3e-7, 5) AS se, count(*) AS n FROM loc GROUP BY 1")
def radial_average(df):
    out = agg.radial_average(df, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "intensity")
    return rounded(out.withColumns({c: F.col(c) + 3e-7 for c in ("mean", "se")}), 5)  # off the halves that means of cents hit


_GRID = [{"noise": n, "signal": s} for n in (2, 4, 6) for s in (10000, 30000)]


@query(LOC + ", g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {p['noise']}, {p['signal']})" for k, p in enumerate(_GRID)) + ") t(filter_id, a, b)) SELECT filter_id, sum(CASE WHEN orig_value <> 0 AND noise <= a AND intensity >= b THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN orig_value = 0 AND noise <= a AND intensity >= b THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN orig_value = 0 AND NOT (noise <= a AND intensity >= b) THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN orig_value <> 0 AND NOT (noise <= a AND intensity >= b) THEN 1 ELSE 0 END) AS fn FROM loc, g GROUP BY filter_id")
def filter_analysis(df):
    return agg.filter_grid(df, _GRID, lambda p: (F.col("noise") <= p["noise"]) & flt.signal(p["signal"]))


@query(LOC + "SELECT CAST(floor(x * 2) AS INT) AS px, CAST(floor(y * 2) AS INT) AS py, round(sum(intensity), 3) AS value FROM loc GROUP BY ALL")
def render_add(df):
    return rounded(agg.render(df, 2.0), 3)


@query(LOC + "SELECT CAST(floor(x * 2) AS INT) AS px, CAST(floor(y * 2) AS INT) AS py, max(intensity) AS value FROM loc GROUP BY ALL")
def render_max(df):
    return agg.render(df, 2.0, "max")


@query(LOC + "SELECT CAST(floor(x * 2) AS INT) AS px, CAST(floor(y * 2) AS INT) AS py, arg_max(intensity, row_id) AS value FROM loc GROUP BY ALL")
def render_replace(df):
    return agg.render(df, 2.0, "replace")


@query(LOC + ", f AS (SELECT intensity, floor(x * 2 - 0.5) AS x0, floor(y * 2 - 0.5) AS y0, x * 2 - 0.5 - floor(x * 2 - 0.5) AS fx, y * 2 - 0.5 - floor(y * 2 - 0.5) AS fy FROM loc), p AS (SELECT x0 + i AS px, y0 + j AS py, intensity * (CASE WHEN i = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN j = 1 THEN fy ELSE 1 - fy END) AS v FROM f, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(sum(v), 1) AS value FROM p GROUP BY ALL")
def render_weighted(df):
    return rounded(agg.render(df, 2.0, weighted=True), 1)


# --- windows ------------------------------------------------------------------------------------------------------------


@query(LOC + ", j AS (SELECT id, row_id, frame, CASE WHEN frame - lag(frame) OVER w > 5 OR (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) > 900 THEN 1 ELSE 0 END AS new FROM loc WINDOW w AS (PARTITION BY id ORDER BY frame, row_id)) SELECT id, row_id, CAST(sum(new) OVER (PARTITION BY id ORDER BY frame, row_id) AS INT) AS part FROM j")
def split_tracks(df):
    return tracks.islands(df, 5, 30.0).select("id", "row_id", "part")


@query(LOC + "SELECT id, row_id, CAST(floor((row_number() OVER (PARTITION BY id ORDER BY frame, row_id) - 1) / 3.0) AS INT) AS part FROM loc")
def split_long_tracks(df):
    return tracks.split_long(df, 3).select("id", "row_id", "part")


@query(EV + ", c AS (SELECT id, frame, count(*) AS c FROM ev GROUP BY ALL), n AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY id ORDER BY frame) > 25 THEN 1 ELSE 0 END AS new FROM c), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id ORDER BY frame) AS INT) AS burst FROM n) SELECT id, burst, min(frame) AS first_frame, max(frame) AS last_frame, sum(c) AS size FROM b GROUP BY id, burst HAVING sum(c) >= 2", stream_rows)
def bursts(df):
    return tracks.bursts(df, 24, 2)


@query(LOC + ", n AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY id ORDER BY frame) > 11 THEN 1 ELSE 0 END AS new FROM loc), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id ORDER BY frame) AS INT) AS burst FROM n), s AS (SELECT id, burst, count(*) AS size, max(frame) - min(frame) + 1 AS duration, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM b GROUP BY id, burst HAVING count(*) >= 2) SELECT id, burst, size, duration, round(area, 6) AS area, round(CASE WHEN area > 0 THEN size / area END, 6) AS density FROM s")
def burst_clusters(df):
    return rounded(tracks.burst_clusters(df, 10, 2), 6)


@query(LOC + "SELECT CAST(floor(x * 2) AS INT) AS px, CAST(floor(y * 2) AS INT) AS py, round(sum(intensity), 3) AS value FROM loc WHERE frame > (SELECT max(frame) FROM loc) - 100 GROUP BY ALL")
def render_rolling(df):
    """The image of the last 100 frames."""
    last = df.agg(F.max("frame").alias("f")).first()["f"] or 0
    return rounded(agg.render(df.where(F.col("frame") > last - 100), 2.0), 3)


@query(LOC + "SELECT CAST(floor(frame / 100.0) AS INT) AS block, CAST(floor(x * 2) AS INT) AS px, CAST(floor(y * 2) AS INT) AS py, round(sum(intensity), 3) AS value FROM loc GROUP BY ALL")
def render_blocks(df):
    """An image of every 100 frames."""
    return rounded(agg.render(df.withColumn("block", F.floor(F.col("frame") / 100).cast("int")), 2.0, on=("block",)), 3)


@query(LOC + ", n AS (SELECT *, CASE WHEN frame >= lag(end_frame) OVER (PARTITION BY id ORDER BY frame, row_id) + 11 THEN 1 ELSE 0 END AS new FROM loc) SELECT row_id, CAST(sum(new) OVER (PARTITION BY id ORDER BY frame, row_id) AS INT) AS activation, CASE WHEN frame % 30 = 1 THEN 1 WHEN frame % 30 = 11 THEN 2 ELSE 0 END AS channel FROM n")
def activations(df):
    return tracks.activations(df, 10, 30, [1, 11]).select("row_id", "activation", "channel")


@query(LOC + ", k AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY frame, row_id) AS k FROM loc) SELECT a.id, CAST(b.k - a.k AS INT) AS lag, round(avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 9) AS msd, count(*) AS n FROM k a JOIN k b ON a.id = b.id AND b.k > a.k AND b.k - a.k <= 4 GROUP BY 1, 2")
def msd_lags(df):
    return rounded(tracks.msd_by_lag(df, 4))


@query(LOC + ", s AS (SELECT id, row_id, category, x, y, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step, row_number() OVER w AS k FROM loc WINDOW w AS (PARTITION BY id ORDER BY frame, row_id)), f AS (SELECT id, lead(row_id, 1) OVER v AS row_id, lead(row_id, 2) OVER v AS last, (lead(step, 1) OVER v + lead(step, 2) OVER v) / 2 AS mean_step, (lead(step, 1) OVER v * lead(step, 1) OVER v + lead(step, 2) OVER v * lead(step, 2) OVER v) / 8 AS d, lead(category, 1) OVER v AS category, sqrt((lead(x, 2) OVER v - x) * (lead(x, 2) OVER v - x) + (lead(y, 2) OVER v - y) * (lead(y, 2) OVER v - y)) AS drift FROM s WINDOW v AS (PARTITION BY id ORDER BY k)) SELECT id, 0 AS part, row_id, round(mean_step, 9) AS mean_step, round(drift, 9) AS drift, round(CASE WHEN mean_step > 0 THEN drift / (mean_step * 2) END, 9) AS straightness, round(d, 9) AS d, category FROM f WHERE last IS NOT NULL")
def sliding_features(df):
    return rounded(tracks.sliding_features(df.withColumn("frame", F.row_number().over(tracks.by_track())), 3))


@query(LOC + ", b AS (SELECT CAST(floor(intensity / 5000) AS BIGINT) AS bin, count(*) AS n FROM loc GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS fraction FROM b")
def cumulative_histogram(df):
    return rounded(tracks.cumulative(df, "intensity", 5000), 6)


@query(LOC + "SELECT frame, row_id, intensity FROM loc QUALIFY row_number() OVER (PARTITION BY frame ORDER BY intensity DESC, row_id) <= 2")
def top_per_frame(df):
    ranked = df.withColumn("_k", tracks.first_by(F.desc("intensity")))
    return ranked.where("_k <= 2").select("frame", "row_id", "intensity")


@query(LOC + ", a AS (SELECT * FROM loc WHERE category = 1 OR noise > 3), b AS (SELECT * FROM loc WHERE noise > 5) SELECT 'except' AS kind, count(*) AS n FROM a WHERE row_id NOT IN (SELECT row_id FROM b) UNION ALL SELECT 'retain', count(*) FROM a WHERE row_id IN (SELECT row_id FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT row_id FROM a UNION SELECT row_id FROM b)")
def set_operations(df):
    a, b = df.where("category = 1 OR noise > 3").select("row_id"), df.where("noise > 5").select("row_id")
    named = lambda d, kind: d.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return named(agg.except_rows(a, b), "except").union(named(agg.retain_rows(a, b), "retain")).union(named(a.union(b).dropDuplicates(), "union"))


@query(LOC + ", a AS (SELECT dense_rank() OVER (ORDER BY id) AS id, row_id, 0 AS dataset FROM loc WHERE category = 1), b AS (SELECT dense_rank() OVER (ORDER BY id) + (SELECT coalesce(max(id), 0) FROM a) AS id, row_id, 1 AS dataset FROM loc WHERE category = 2) SELECT * FROM a UNION ALL SELECT * FROM b")
def combine_datasets(df):
    return agg.dense_ids(df.where("category = 1").select("id", "row_id"), df.where("category = 2").select("id", "row_id")).select("id", "row_id", "dataset")


# --- spatial, tracing and clustering -----------------------------------------------------------------------------------------


@query(LOC + ", n AS (SELECT a.row_id, b.row_id AS neighbour, b.intensity, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM loc a JOIN loc b ON a.id = b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 100 AND ((b.end_frame >= a.frame - 30 AND b.end_frame < a.frame) OR (b.frame > a.frame AND b.frame <= a.frame + 30))) SELECT row_id, neighbour, round(sqrt(d2), 9) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY intensity DESC, neighbour) = 1")
def neighbours_in_track(df):
    """Neighbours among the rows of one id: the ids are the regions of this table."""
    rows = df.select("row_id", "id", "frame", "end_frame", "x", "y", "intensity")
    near = spatial.within_key(rows, rows, 10.0, "id", strict=True)
    before = (F.col("b_end_frame") >= F.col("a_frame") - 30) & (F.col("b_end_frame") < F.col("a_frame"))
    after = (F.col("b_frame") > F.col("a_frame")) & (F.col("b_frame") <= F.col("a_frame") + 30)
    best = near.where(before | after).groupBy("a_row_id").agg(F.max_by(F.struct("b_row_id", "d2"), F.struct("b_intensity", -F.col("b_row_id"))).alias("_b"))
    return rounded(best.select(F.col("a_row_id").alias("row_id"), F.col("_b.b_row_id").alias("neighbour"), F.sqrt("_b.d2").alias("distance")))


@query(PT + ", c AS (SELECT a.row_id, count(*) AS n FROM pt a JOIN pt b ON a.row_id <> b.row_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY 1) SELECT row_id, coalesce(n, 0) AS n, round(n / ((SELECT count(*) FROM pt) / 10000.0), 9) AS k, round(sqrt(n / ((SELECT count(*) FROM pt) / 10000.0) / pi()), 9) AS l, round(sqrt(n / ((SELECT count(*) FROM pt) / 10000.0) / pi()) - 2, 9) AS l_minus_r FROM pt LEFT JOIN c USING (row_id)", points)
def ripley_density(df):
    out = spatial.ripley(df, 2.0, 10000.0)
    return rounded(out.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("k", "l", "l_minus_r")}))


@query(PT + ", e AS (SELECT min(x) + 5 AS x0, max(x) - 5 AS x1, min(y) + 5 AS y0, max(y) - 5 AS y1 FROM pt), c AS (SELECT pt.* FROM pt, e WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), p AS (SELECT CAST(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.5) AS BIGINT) AS ring FROM c a JOIN pt b ON a.row_id <> b.row_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 25) SELECT ring, count(*) AS pairs, round(count(*) / ((SELECT count(*) FROM c) * pi() * 0.25 * ((ring + 1) * (ring + 1) - ring * ring)), 6) AS g FROM p GROUP BY ring", points)
def pair_correlation(df):
    """Around every row that lies the radius inside the bounds of all rows."""
    return rounded(spatial.pair_correlation(df, 5.0, 0.5), 6)


@query(PT.replace("WITH", "WITH RECURSIVE") + ", e AS (SELECT a.row_id AS a, b.row_id AS b FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25), r AS (SELECT row_id AS a, row_id AS b FROM pt UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS row_id, min(b) AS cluster FROM r GROUP BY a", points)
def single_linkage(df):
    return spatial.single_linkage(df, 0.5)


_DBSCAN = PT.replace("WITH", "WITH RECURSIVE") + ", e AS (SELECT a.row_id AS a, b.row_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1), k AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), ce AS (SELECT e.* FROM e WHERE a IN (SELECT a FROM k) AND b IN (SELECT a FROM k)), r AS (SELECT a, a AS b FROM k UNION SELECT r.a, ce.b FROM r JOIN ce ON r.b = ce.a), c AS (SELECT a AS row_id, min(b) AS cluster FROM r GROUP BY a), n AS (SELECT a AS row_id, arg_min(b, (d2, b)) AS near FROM e WHERE a NOT IN (SELECT a FROM k) AND b IN (SELECT a FROM k) GROUP BY a) SELECT pt.row_id, coalesce(c.cluster, cn.cluster) AS cluster, c.row_id IS NOT NULL AS core FROM pt LEFT JOIN c USING (row_id) LEFT JOIN n ON n.row_id = pt.row_id LEFT JOIN c cn ON cn.row_id = n.near"


@query(_DBSCAN, points)
def dbscan(df):
    return spatial.dbscan(df, 1.0, 4)


@query("SELECT row_id, cluster FROM (" + _DBSCAN + ") WHERE core", points)
def optics_cores(df):
    """The density order cut at its own reach gives the cores of the same clusters; each is named by its smallest core."""
    cut = clustering.cut_ordering(clustering.optics(df, 1.0, 4), 1.0).where("core").select("row_id", "cluster")
    names = cut.groupBy("cluster").agg(F.min("row_id").alias("_first"))
    return cut.join(names, "cluster").select("row_id", F.col("_first").alias("cluster"))


@query(PT + ", c AS (SELECT a.row_id, a.id % 2 + 1 AS own, sum(CASE WHEN b.id % 2 = 0 THEN 1 ELSE 0 END) AS o1, sum(CASE WHEN b.id % 2 = 1 THEN 1 ELSE 0 END) AS o2 FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 GROUP BY 1, 2), d AS (SELECT *, (o1 - 0.2 * o2) / (1 - 0.02) AS d1 FROM c), e AS (SELECT *, o2 - 0.1 * d1 AS d2 FROM d) SELECT row_id, o1, o2, round(d1, 6) AS d1, round(d2, 6) AS d2, CAST(CASE WHEN d1 > d2 THEN 1 WHEN d1 < d2 THEN 2 ELSE own END AS INT) AS channel FROM e", points)
def unmix_channels(df):
    return rounded(spatial.unmix_channels(df.withColumn("channel", F.col("id") % 2 + 1), 3.0, 0.1, 0.2), 6).withColumn("channel", F.col("channel").cast("int"))


@query(PT.replace("WITH", "WITH RECURSIVE") + ", o AS (SELECT a.row_id AS a, b.row_id AS b, row_number() OVER (ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), a.row_id, b.row_id) AS k FROM pt a JOIN pt b ON a.row_id < b.row_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1), m AS (SELECT k, a, b, true AS ok, [a, b] AS held FROM o WHERE k = 1 UNION ALL SELECT o.k, o.a, o.b, NOT (list_contains(held, o.a) AND list_contains(held, o.b)), list_distinct(held || [o.a, o.b]) FROM m JOIN o ON o.k = m.k + 1), e AS (SELECT a, b FROM m WHERE ok UNION ALL SELECT b, a FROM m WHERE ok), r AS (SELECT row_id AS a, row_id AS b FROM pt UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS row_id, min(b) AS cluster FROM r GROUP BY a", points)
def particle_single_linkage(df):
    return clustering.particle_single_linkage(df, 1.0)


@query(table=points)
def centroid_linkage(df):
    return clustering.agglomerate(df, 0.5)


@query(table=points)
def particle_linkage(df):
    return clustering.agglomerate(df.withColumn("frame", F.col("row_id") % 50).withColumn("end_frame", F.col("frame")), 0.5, "particle", 10, "time")


@query(PT.replace("WITH", "WITH RECURSIVE") + ", p AS (SELECT row_id, CAST(trunc(x) AS INT) AS px, CAST(trunc(y) AS INT) AS py FROM pt), e AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON abs(a.px - b.px) <= 2 AND abs(a.py - b.py) <= 2), r AS (SELECT row_id AS a, row_id AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS row_id, min(b) AS cluster FROM r GROUP BY a), q AS (SELECT cluster, row_id, px + i AS qx, py + j AS qy FROM c JOIN p USING (row_id), (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j)) SELECT cluster, count(DISTINCT row_id) AS n, count(DISTINCT (qx, qy)) AS area, round(count(DISTINCT row_id) / count(DISTINCT (qx, qy)), 9) AS density FROM q GROUP BY cluster", points)
def local_density(df):
    return rounded(spatial.local_density(df, 1))


@query(LOC.replace("WITH", "WITH RECURSIVE", 1) + ", p AS (SELECT a.frame, a.row_id AS a, b.row_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM loc a JOIN loc b ON a.frame = b.frame AND a.category = 1 AND b.category = 2), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d2, a, b) AS k FROM p WHERE d2 <= 25), m AS (SELECT frame, k, a, b, d2, true AS ok, [a] AS ua, [b] AS ub FROM o WHERE k = 1 UNION ALL SELECT o.frame, o.k, o.a, o.b, o.d2, NOT (list_contains(ua, o.a) OR list_contains(ub, o.b)), CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ua ELSE list_append(ua, o.a) END, CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ub ELSE list_append(ub, o.b) END FROM m JOIN o ON o.frame = m.frame AND o.k = m.k + 1) SELECT frame, a AS a_row_id, b AS b_row_id, round(sqrt(d2), 9) AS distance FROM m WHERE ok")
def match_per_frame(df):
    """Rows of two categories matched one to one within a frame."""
    return rounded(spatial.match_frames(df.where("category = 1"), df.where("category = 2"), 5.0))


_REGIONS = LOC.replace("WITH", "WITH RECURSIVE", 1) + ", p AS (SELECT DISTINCT row_id, frame, CAST(trunc(x) AS INT) AS px, CAST(trunc(y) AS INT) AS py FROM loc WHERE frame % 5 = 0), e AS (SELECT a.row_id AS a, b.row_id AS b FROM p a JOIN p b ON a.frame = b.frame AND abs(a.px - b.px) <= 4 AND abs(a.py - b.py) <= 4), r AS (SELECT row_id AS a, row_id AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS row_id, min(b) AS cluster FROM r GROUP BY a), q AS (SELECT frame, cluster, row_id, px + i AS qx, py + j AS qy FROM c JOIN p USING (row_id), (VALUES (-2), (-1), (0), (1), (2)) s(i), (VALUES (-2), (-1), (0), (1), (2)) t(j)), g AS (SELECT frame, cluster, count(DISTINCT row_id) AS n, count(DISTINCT (qx, qy)) AS area FROM q GROUP BY frame, cluster) "


@query(_REGIONS + "SELECT frame, cluster, n, area, round(n / area, 9) AS density FROM g")
def density_by_frame(df):
    """Regions of overlapping squares in each frame."""
    return rounded(spatial.density_regions(df.where("frame % 5 = 0"), 2, on=("frame",)))


@query(_REGIONS + "SELECT count(*) AS regions, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS singles, round(sum(n) / sum(area), 9) AS density, round(avg(n / area), 9) AS mean, round(stddev_samp(n / area), 9) AS sd FROM g")
def density_estimate(df):
    return rounded(spatial.density_estimate(spatial.density_regions(df.where("frame % 5 = 0"), 2, on=("frame",))))


@query(PT + ", c AS (SELECT a.row_id, count(*) AS n FROM pt a JOIN pt b ON a.row_id <> b.row_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY 1), k AS (SELECT row_id, coalesce(n, 0) AS n, coalesce(n, 0) / ((SELECT count(*) FROM pt) / 10000.0) AS k FROM pt LEFT JOIN c USING (row_id)) SELECT row_id, n, round(k, 9) AS k, round(k / 16, 9) AS k_area, round(sqrt(k / 4), 9) AS l, round(sqrt(k / 4) - 2, 9) AS l_minus_r, round(sqrt(k / 4) / 2, 9) AS l_ratio, round(sqrt(k / 4) / 2 - 1, 9) AS l_excess FROM k", points)
def ripley_squares(df):
    return rounded(spatial.ripley_forms(df, 2.0, 10000.0, square=True))


_ERF = "(1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z))"


@query(PT + ", p AS (SELECT a.row_id AS a, b.row_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pt a JOIN pt b ON a.row_id <> b.row_id), n AS (SELECT * FROM p WHERE d2 <= 36 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) <= 4), s AS (SELECT a, sqrt(avg(d2)) AS p FROM n GROUP BY a), o AS (SELECT n.a, avg(s.p) AS o FROM n JOIN s ON s.a = n.b GROUP BY n.a), l AS (SELECT s.a AS row_id, s.p / o.o - 1 AS plof FROM s JOIN o USING (a)), m AS (SELECT sqrt(avg(plof * plof)) AS norm FROM l), z AS (SELECT row_id, plof, plof / (3 * norm * sqrt(2)) AS z, 1 / (1 + 0.3275911 * (plof / (3 * norm * sqrt(2)))) AS t FROM l, m) SELECT pt.row_id, round(plof, 8) AS plof, round(CASE WHEN plof IS NULL THEN 1 WHEN plof <= 0 THEN 0 ELSE " + _ERF + " END, 8) AS score FROM pt LEFT JOIN z USING (row_id)", points)
def outlier_scores(df):
    return rounded(spatial.outlier_scores(df, 4, 6.0), 8)


@query(LOC + _BLINK.format(t="loc") + ", o AS (SELECT gap - 1 AS t_off, count(*) AS n FROM j WHERE gap > 1 GROUP BY 1), c AS (SELECT t_off, 100 * sum(n) OVER (ORDER BY t_off) / sum(n) OVER () AS percent FROM o) SELECT t_off, round(percent, 9) AS percent FROM c WHERE percent >= 80 ORDER BY t_off LIMIT 1")
def dark_time_percentile(df):
    return rounded(tracks.dark_time_percentile(df, 80.0))


@query(EV + ", f AS (SELECT id, frame, arg_min(x, row_id) AS x, arg_min(y, row_id) AS y FROM ev GROUP BY id, frame), j AS (SELECT l.lag, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS j FROM f a JOIN f b ON a.id = b.id JOIN (VALUES (1), (2), (5), (24)) l(lag) ON b.frame = a.frame + l.lag) SELECT lag, CAST(floor(j / 0.5) AS BIGINT) AS bin, count(*) AS n FROM j GROUP BY ALL", stream_rows)
def jump_histogram(df):
    first = df.groupBy("id", "frame").agg(*[F.min_by(c, "row_id").alias(c) for c in ("x", "y")])
    return tracks.jump_histogram(first, [1, 2, 5, 24], 0.5)


@query(LOC + ", b AS (SELECT floor(min(x)) AS x0, ceil(max(x)) AS x1, floor(min(y)) AS y0, ceil(max(y)) AS y1 FROM loc) SELECT row_id, round(x - greatest(x0 + 3, 10), 9) AS x, round(y - (y0 + 3), 9) AS y FROM loc, b WHERE x >= greatest(x0 + 3, 10) AND x < least(x1 - 3, 40) AND y >= y0 + 3 AND y < least(y1 - 3, 80) AND z BETWEEN 0.02 AND 0.08")
def crop_border(df):
    """The bounds less a border, within a box and a range of depths, moved to the origin."""
    return rounded(flt.crop_to(df, 3.0, (10.0, 0.0, 30.0, 80.0), z=(0.02, 0.08), reset=True).select("row_id", "x", "y"))


_KINDS = LOC + ", k AS (SELECT CAST(l.category AS INT) AS a, CAST(m.noise AS INT) AS b FROM loc l JOIN loc m USING (row_id))"


@query(_KINDS + ", n AS (SELECT a, b, count(*) AS n FROM k GROUP BY ALL) SELECT a AS expected, b AS found, n FROM n")
def match_classes(df):
    """Confusion counts of two labellings of the same rows."""
    return matching.confusion(df.select("row_id", F.col("category").alias("label")), df.select("row_id", F.col("noise").cast("int").alias("label")))


@query(_KINDS + ", m AS (SELECT count(*) AS n, count(DISTINCT a) AS ka, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS agree FROM k), e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) AS s FROM (SELECT a, count(*) AS n FROM k GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM k GROUP BY b) y ON x.a = y.b) SELECT n, agree, round(agree / n, 9) AS accuracy, round((agree / n - s / n / n) / (1 - s / n / n), 9) AS kappa FROM m, e")
def match_agreement(df):
    return rounded(matching.agreement(matching.confusion(df.select("row_id", F.col("category").alias("label")), df.select("row_id", F.col("noise").cast("int").alias("label")))))


@query(LOC.replace("WITH", "WITH RECURSIVE", 1) + ", x AS (SELECT row_id, unnest(CASE WHEN frame = end_frame THEN [frame] ELSE [frame, end_frame] END) AS frame, x, y, category FROM loc WHERE frame % 5 = 0), p AS (SELECT a.frame, a.row_id AS a, b.row_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM x a JOIN x b ON a.frame = b.frame AND a.category = 1 AND b.category = 2), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d2, a, b) AS k FROM p WHERE d2 <= 16), m AS (SELECT frame, k, a, b, true AS ok, [a] AS ua, [b] AS ub FROM o WHERE k = 1 UNION ALL SELECT o.frame, o.k, o.a, o.b, NOT (list_contains(ua, o.a) OR list_contains(ub, o.b)), CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ua ELSE list_append(ua, o.a) END, CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ub ELSE list_append(ub, o.b) END FROM m JOIN o ON o.frame = m.frame AND o.k = m.k + 1), t AS (SELECT count(*) FILTER (WHERE ok) AS tp FROM m), c AS (SELECT count(*) FILTER (WHERE category = 1) AS na, count(*) FILTER (WHERE category = 2) AS nb FROM x) SELECT tp, nb - tp AS fp, na - tp AS fn, round(tp / na, 9) AS recall, round(tp / nb, 9) AS precision, round(tp / (na + nb - tp), 9) AS jaccard FROM t, c")
def match_results(df):
    """Scores of a match in the first and last frame of rows that span several."""
    some = df.where("frame % 5 = 0")
    return rounded(matching.match_scores(some.where("category = 1"), some.where("category = 2"), 4.0, coordinates="first_or_last"))


_TRACED = "(SELECT id, avg(x) AS x, avg(y) AS y, min(frame) AS a, max(end_frame) AS b FROM loc WHERE category = {k} GROUP BY id)"


@query(LOC.replace("WITH", "WITH RECURSIVE", 1) + f", ta AS {_TRACED.format(k=1)}, tb AS {_TRACED.format(k=2)}, p AS (SELECT ta.id AS a, tb.id AS b, (ta.x - tb.x) * (ta.x - tb.x) + (ta.y - tb.y) * (ta.y - tb.y) AS d2, least(ta.b, tb.b) - greatest(ta.a, tb.a) + 1 AS overlap FROM ta JOIN tb ON least(ta.b, tb.b) >= greatest(ta.a, tb.a)), o AS (SELECT *, row_number() OVER (ORDER BY d2, a, b) AS k FROM p WHERE d2 <= 100), m AS (SELECT k, a, b, d2, overlap, true AS ok, [a] AS ua, [b] AS ub FROM o WHERE k = 1 UNION ALL SELECT o.k, o.a, o.b, o.d2, o.overlap, NOT (list_contains(ua, o.a) OR list_contains(ub, o.b)), CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ua ELSE list_append(ua, o.a) END, CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ub ELSE list_append(ub, o.b) END FROM m JOIN o ON o.k = m.k + 1) SELECT a AS a_row_id, b AS b_row_id, round(sqrt(d2), 9) AS distance, CAST(overlap AS INT) AS overlap FROM m WHERE ok")
def match_traces(df):
    """Traces matched by the distance of their centres among those that overlap in time."""
    return rounded(matching.match_traces(df.where("category = 1"), df.where("category = 2"), 10.0))


def _tracks_of(df: DataFrame) -> DataFrame:
    return df.select("row_id", "frame", "end_frame", "x", "y", "intensity")


def _traced(memory: int, batch: str = "", rows: str = "ev", also: str = "", name: str = "t") -> str:
    """Common tables up to ``name``(row_id, trace): links of rows of one y, taken in order where both ends are still free."""
    taken = "(list_contains(ua, o.a) OR list_contains(ub, o.b))"
    return (
        f", {name}_o AS (SELECT a.row_id AS a, b.row_id AS b, a.y, b.frame - a.frame AS gap, row_number() OVER (PARTITION BY a.y ORDER BY b.frame, {batch} abs(a.x - b.x), a.row_id, b.row_id) AS k FROM {rows} a JOIN {rows} b ON a.y = b.y AND b.frame > a.frame AND b.frame <= a.frame + {memory} AND abs(a.x - b.x) <= 0.05 {also})"
        f", {name}_m AS (SELECT y, k, a, b, gap, true AS ok, [a] AS ua, [b] AS ub FROM {name}_o WHERE k = 1 UNION ALL SELECT o.y, o.k, o.a, o.b, o.gap, NOT {taken}, CASE WHEN {taken} THEN ua ELSE list_append(ua, o.a) END, CASE WHEN {taken} THEN ub ELSE list_append(ub, o.b) END FROM {name}_m m JOIN {name}_o o ON o.y = m.y AND o.k = m.k + 1)"
        f", {name} AS (SELECT row_id, row_id AS trace, 0 AS gap FROM {rows} WHERE row_id NOT IN (SELECT b FROM {name}_m WHERE ok) UNION ALL SELECT l.b, t.trace, l.gap FROM {name} t JOIN {name}_m l ON l.a = t.row_id AND l.ok)"
    )


_EV = EV.replace("WITH", "WITH RECURSIVE", 1)
_SURE = ", sure AS (SELECT * FROM ev WHERE intensity > 40)"


@query(_EV + _traced(24, "-a.frame,") + " SELECT row_id, trace FROM t", stream_rows)
def trace_latest(df):
    return tracing.trace(_tracks_of(df), 0.05, 24)


@query(_EV + _traced(24, "a.frame,", also="AND floor((a.frame - 1) / 168.0) = floor((b.frame - 1) / 168.0)") + " SELECT row_id, trace FROM t", stream_rows)
def trace_pulses(df):
    return tracing.trace(_tracks_of(df), 0.05, 24, mode="earliest", pulse=24 * 7)


@query(_EV + _traced(24) + ", f AS (SELECT trace, row_number() OVER (ORDER BY min(frame), trace) AS id FROM t JOIN ev USING (row_id) GROUP BY trace) SELECT row_id, id FROM t JOIN f USING (trace)", stream_rows)
def trace_numbers(df):
    return tracing.number_traces(tracing.trace(_tracks_of(df), 0.05, 24, mode="single"), df)


@query(_EV + _traced(24, "-a.frame,") + " SELECT row_id FROM t WHERE trace IN (SELECT trace FROM t GROUP BY trace HAVING count(*) > 1)", stream_rows)
def trace_filter(df):
    return tracing.trace_filter(_tracks_of(df), 0.05, 24).select("row_id")


@query(_EV + _SURE + _traced(24, "-a.frame,", "sure") + " SELECT row_id FROM t WHERE trace IN (SELECT trace FROM t JOIN ev USING (row_id) WHERE intensity > 80)", stream_rows)
def hysteresis_filter(df):
    return tracing.hysteresis(_tracks_of(df), F.col("intensity") > 80, F.col("intensity") > 40, 0.05, 24).select("row_id")


_BLINKS_OF = "SELECT CAST(0.05 AS DOUBLE) AS distance, {m} AS memory, count(*) AS traces, round(avg(n), 6) AS mean_blinks FROM (SELECT trace, 1 + sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS n FROM {t} GROUP BY trace)"


@query(_EV + _traced(1, name="t1") + _traced(24, "-a.frame,", name="t24") + " " + _BLINKS_OF.format(m=1, t="t1") + " UNION ALL " + _BLINKS_OF.format(m=24, t="t24"), stream_rows)
def trace_thresholds(df):
    return rounded(tracing.threshold_grid(_tracks_of(df), [0.05], [1, 24]), 6)


@query(table=stream_rows)
def multiple_target(df):
    return tracing.multiple_target(_tracks_of(df), 1e-6, gap=15)


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 9) AS signal FROM events GROUP BY 1", lambda spark, sf_dir: read(spark, sf_dir, "events"))
def tumbling_frames(df):
    return rounded(streams.tumbling(df.select(F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("intensity")), "1 day")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH c AS (SELECT user_id AS id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT id, min(ts) AS start, count(*) AS size FROM b GROUP BY id, k", lambda spark, sf_dir: read(spark, sf_dir, "events"))
def burst_sessions(df):
    rows = df.select(F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("id"))
    return streams.burst_sessions(rows, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- sources and sinks ----------------------------------------------------------------------------------------------------


def _scratch(df: DataFrame) -> str:
    import uuid

    from ..operators.graph import shared_dir

    return f"{shared_dir(df.sparkSession)}/spotlattice/{uuid.uuid4().hex}"


@query(LOC + "SELECT row_id, frame, x * 100 AS x, y, intensity FROM loc")
def source_delimited(df):
    """Written as text with positions in other units, read back by a column map."""
    path = _scratch(df)
    formats.write_text(df, path, ["row_id", "frame", "x", "y", "intensity"], {"x": 100.0})
    return formats.read_text(df.sparkSession, path, "row_id long, frame int, x double, y double, intensity double")


@query("SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_linenumber AS INT) AS frame, CAST(l_partkey AS DOUBLE) AS intensity FROM lineitem", lambda spark, sf_dir: read(spark, sf_dir, "lineitem"))
def source_malk(df):
    path = _scratch(df)
    formats.write_malk(df.selectExpr("l_quantity AS x", "l_extendedprice AS y", "l_linenumber AS frame", "l_partkey AS intensity"), path)
    return formats.malk(df.sparkSession, path)


@query(LOC + "SELECT frame, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(noise AS FLOAT) AS DOUBLE) AS noise, count(*) AS n FROM loc GROUP BY ALL")
def source_binary(df):
    path = _scratch(df)
    formats.write_binary(df.select("frame", *[F.col(c).cast("float") for c in ("x", "y", "intensity", "noise")]), path)
    return formats.read_binary(df.sparkSession, path).groupBy("frame", F.col("x").cast("double").alias("x"), F.col("noise").cast("double").alias("noise")).agg(F.count("*").alias("n"))


@query(LOC + "SELECT CAST(id AS INT) AS id, category, frame, end_frame, noise, intensity, x, y FROM loc")
def source_results(df):
    """Result files with their columns named in the first line, read back."""
    path = _scratch(df)
    formats.write_results(df.select("id", "category", "frame", "end_frame", "noise", "intensity", "x", "y"), path, {"x": "px", "y": "px"})
    return formats.read_results(df.sparkSession, path)


_RECORD = LOC + "SELECT CAST(id % 100000 AS INT) AS id, category, frame, end_frame, " + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in ("noise", "mean_intensity", "background", "intensity", "x", "y", "z", "sx", "sy")) + ", round(CAST(CAST(coalesce(precision, 0) AS FLOAT) AS DOUBLE), 4) AS precision, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS x_sd FROM loc"


def _records(df: DataFrame) -> DataFrame:
    whole = df.select((F.col("id") % 100000).cast("int").alias("id"), "category", "frame", "end_frame", F.lit(0).alias("orig_x"), F.lit(0).alias("orig_y"), "orig_value", "noise", "mean_intensity", "background", "intensity", "x", "y", "z", "sx", "sy", "precision")
    return whole.withColumn("x_sd", F.col("z"))


def _read_back(df: DataFrame) -> DataFrame:
    kept = ("noise", "mean_intensity", "background", "intensity", "x", "y", "z", "sx", "sy", "precision", "x_sd")
    return rounded(df.select("id", "category", "frame", "end_frame", *[F.col(c).cast("double").alias(c) for c in kept]), 4)


@query(_RECORD)
def source_text_records(df):
    """Text records with every optional field and deviations, read back by their headers."""
    path, rows = _scratch(df), _records(df)
    records.write_text(rows, path, records.layout_for(rows, "Text", deviations=True), {"x": "px", "y": "px", "intensity": "count"}, {"nmPerPixel": 100})
    return _read_back(records.read_text(df.sparkSession, path))


@query(_RECORD)
def source_binary_records(df):
    path, rows = _scratch(df), _records(df)
    records.write_binary(rows, path, records.layout_for(rows, "Binary", deviations=True))
    return _read_back(records.read_binary(df.sparkSession, path))


@query(LOC + "SELECT frame, end_frame, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(intensity AS FLOAT) AS DOUBLE) AS intensity, category FROM loc")
def source_tsf(df):
    """Tagged spot files, one a partition, read back."""
    path = _scratch(df).removeprefix("file:")
    tsf.write(df.select("frame", "end_frame", "x", "y", "intensity", "noise", "category"), path)
    doubles = [F.col(c).cast("double").alias(c) for c in ("x", "intensity")]
    return tsf.read(df.sparkSession, path).select("frame", "end_frame", *doubles, "category")


# --- pipelines of analysis ------------------------------------------------------------------------------------------------


@query(table=stream_rows)
def blink_estimate(df):
    """Traces at growing dark thresholds and the blinking that fits their counts."""
    from ..functions.fits import blinking

    rows = shared_table(_tracks_of(df))
    wide = shared_table(tracing.trace_components(rows, 0.05, 24).select("row_id", "component"))
    counts = {t: float(tracing.trace(rows, 0.05, t, components=wide).select("trace").distinct().count()) for t in (1, 4, 12, 24)}
    fit = blinking(counts, 4)
    return df.sparkSession.createDataFrame([(t, n, round(float(fit["molecules"]), 2), round(float(fit["blinking_rate"]), 3)) for t, n in counts.items()], "threshold int, traces double, molecules double, blinking_rate double")


@query()
def jump_distance_fit(df):
    """Populations of diffusion from a histogram of all squared jumps: 200 bins for each factor of 10, their means and counts."""
    from ..functions.fits import jump_distances

    jumps = tracks.with_jumps(df).where("jump2 > 0").select("jump2")
    bins = jumps.groupBy(F.floor(F.log10("jump2") * 200).alias("bin")).agg(F.avg("jump2").alias("mean"), F.count("*").alias("n")).orderBy("bin").collect()
    found = jump_distances([r["mean"] for r in bins], counts=[r["n"] for r in bins])
    return df.sparkSession.createDataFrame([(round(float(d), 4), round(float(f), 4)) for d, f in found], "d double, fraction double")


@query()
def residence_fit(df):
    from ..functions.fits import residence

    histogram = {r["t"]: r["n"] for r in tracks.residence_times(df, 2).collect()}  # one row a frame at most
    fit = residence(histogram, 2) if histogram else {"rates": [], "fractions": []}
    return df.sparkSession.createDataFrame([(round(r, 6), round(f, 6)) for r, f in zip(fit["rates"], fit["fractions"], strict=True)], "rate double, fraction double")


@query()
def fourier_resolution(df):
    rows = df.select("row_id", F.col("x"), (F.col("y") / 2).alias("y"), "intensity")
    return df.sparkSession.createDataFrame([(float(imaging.resolution(rows, 2.0, 128)),)], "fire double")


@query(table=points)
def frequency_correlation(df):
    return rounded(drift.frequency_correlation(df, 2.0, None, 20), 6)


@query()
def drift_markers(df):
    return rounded(drift.from_markers(df.withColumn("marker", F.col("category")), 0.05), 6)


@query()
def drift_images(df):
    return rounded(drift.from_images(df, 500, 1.0, 64), 6)


def _frames(spark: SparkSession, sf_dir: str) -> int:
    """How many frames to simulate: one for every 400 events, 25 at least."""
    return max(25, read(spark, sf_dir, "events").count() // 400)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated frames, in step with the events: pixels are not among the driver's tables."""
    return imaging.simulate(spark, _frames(spark, sf_dir))[0]


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The localisations of every 250 ids drawn on 32 x 32 pixels over a base of 100."""
    pixel = F.floor(F.col("y") * 32 / 106) * 32 + F.floor(F.col("x") * 32 / 51)
    drawn = localisations(spark, sf_dir).groupBy(F.floor(F.col("id") / 250).cast("int").alias("frame"), pixel.cast("int").alias("k")).agg(F.sum(F.col("intensity") / 1000).alias("v"))
    maps = drawn.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: (100 + F.coalesce(F.col("m")[k], F.lit(0.0))).cast("float"))
    return maps.select("frame", F.lit(32).alias("width"), F.lit(32).alias("height"), pixels.alias("pixels"))


_RASTERS = LOC + ", d AS (SELECT CAST(floor(id / 250) AS INT) AS frame, CAST(floor(y * 32 / 106) * 32 + floor(x * 32 / 51) AS INT) AS k, sum(intensity / 1000) AS v FROM loc GROUP BY ALL), f AS (SELECT DISTINCT frame FROM d), px AS (SELECT f.frame, g.k, CAST(CAST(100 + coalesce(d.v, 0) AS FLOAT) AS DOUBLE) AS v FROM f CROSS JOIN (SELECT unnest(generate_series(0, 1023)) AS k) g LEFT JOIN d ON d.frame = f.frame AND d.k = g.k)"


@query(table=_images)
def spot_candidates(df):
    return imaging.find_spots(df, 1.3, 3.0, 3)


@query(table=_images)
def fit_spots(df):
    return imaging.fit_frames(df, 1.3)


@query(table=_images)
def smooth_frames(df):
    return imaging.smooth(df, "gaussian", 1.0).select("frame", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(_RASTERS + " SELECT CAST(floor((frame - 1) / 5.0) + 1 AS INT) AS frame, 1024 AS n, round(sum(v), 1) AS total FROM px GROUP BY 1", _rasters)
def sum_frames(df):
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return imaging.aggregate_frames(df, 5).select("frame", F.size("pixels").alias("n"), F.round(total, 1).alias("total"))


@query(_RASTERS + " SELECT CAST(k AS INT) AS pixel, round(avg(v), 4) AS mean, round(var_samp(v), 2) AS variance FROM px GROUP BY k", _rasters)
def pixel_mean_variance(df):
    return imaging.mean_variance(df).select("pixel", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@query(_RASTERS + " SELECT frame, 32 AS width, 32 AS height, round(sum(v), 1) AS total, round(max(v), 2) AS highest FROM px GROUP BY frame", _rasters)
def source_tiff(df):
    """Image files of 10 pages, written and read back."""
    path = _scratch(df).removeprefix("file:")
    numbered_frames = numbered(df.select("frame"), "frame", name="k")
    tiff.write(df.join(numbered_frames, "frame").withColumns({"was": F.col("frame"), "frame": F.col("k").cast("int")}), path, each=10)
    back = tiff.read(df.sparkSession, path).join(numbered_frames.withColumnRenamed("frame", "was"), F.col("frame") == F.col("k"))
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return back.select(F.col("was").alias("frame"), "width", "height", F.round(total, 1).alias("total"), F.round(F.array_max("pixels").cast("double"), 2).alias("highest"))


@query(table=_images)
def pixel_gain(df):
    return rounded(imaging.gain_of(imaging.mean_variance(df)), 6)


@query(table=_images)
def fit_shapes(df):
    return imaging.fit_shapes(df, "elliptical", 1.3)


@query(table=_images)
def multiplied_gain(df):
    photons, gain = imaging.multiplied_gain(df)
    return df.sparkSession.createDataFrame([(round(photons, 4), round(gain, 4))], "photons double, gain double")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of simulated frames matched to where the spots were put, with the scores of the match."""
    frames, truth = imaging.simulate(spark, _frames(spark, sf_dir))
    numbered = lambda df, seed: df.withColumn("row_id", F.xxhash64("frame", "x", "y", F.lit(seed)))
    real, found = shared_table(numbered(truth, 0)), shared_table(numbered(imaging.fit_frames(frames, 1.3).select("frame", "x", "y"), 1))
    pairs = spatial.match_frames(real, found, 2.0).count()
    counts = spark.createDataFrame([(float(pairs), float(found.count() - pairs), 0.0, float(real.count() - pairs))], "tp double, fp double, tn double, fn double")
    return agg.match_metrics(counts).select("recall", "precision", "jaccard")


@query(table=_benchmark)
def benchmark_fits(df):
    return rounded(df, 6)
