"""One query for each operator, over the test tables. ``oracles`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import events, generate, graph, inject, label_rules, labels, metrics, reshape, runs, sampling, scans, scoring, selection, series, windows
from ..sources import tables as T
from ..storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Added before rounding: engines round decimal ties differently, and means of few decimals end in ties.
OFF_TIES = 3.14159e-7


def r6(x: Column | str, name: str | None = None) -> Column:
    return F.round(C.col(x) + OFF_TIES, 6).alias(name or x)


def gappy(cells: DataFrame) -> DataFrame:
    """Every 17th value missing."""
    return cells.withColumn("value", F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the event series with a robust-z probability as score."""
    z = series.robust_normalize(T.event_series(spark, sf_dir))
    return z.select("series_id", "row_idx", "label", F.round(1 - F.exp(-F.abs("z")), 6).alias("score"))


@query
def robust_zscore_flags(spark, sf):
    z = series.robust_normalize(T.event_series(spark, sf))
    flags = z.where(F.abs("z") > 3)
    return flags.groupBy("series_id").agg(F.count("*").alias("n_flags"), r6(F.max(F.abs("z")), "max_z"))


@query
def series_catalog(spark, sf):
    rows = T.event_series(spark, sf)
    step = rows.selectExpr("*", "timestamp - lag(timestamp) over (partition by series_id order by row_idx) as step")
    return step.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("channel").alias("n_channels"), r6(F.coalesce(F.median("step"), F.lit(1.0)), "step_s"),
        r6(F.count_if(F.col("label") == 1) / F.count("*"), "anomaly_row_ratio"), F.min((F.col("label") == -1).cast("int")).alias("unlabeled"),
    )


@query
def delta_t_feature(spark, sf):
    return series.delta_t(T.event_series(spark, sf)).select("series_id", "row_idx", r6("delta_t"))


@query
def fill_forward_backmedian(spark, sf):
    return series.fill(gappy(T.event_series(spark, sf))).select("series_id", "row_idx", r6("filled"))


@query
def robust_normalize(spark, sf):
    return series.robust_normalize(T.embedding_cells(spark, sf)).select("series_id", "row_idx", "channel", r6("z"))


@query
def robust_normalize_ref(spark, sf):
    return series.robust_normalize(T.event_series(spark, sf), reference=F.col("row_idx") < 20).select("series_id", "row_idx", r6("z"))


def _hourly_rows(spark, sf):
    return reshape.row_numbers(T.hourly_cells(spark, sf).withColumn("key", F.col("channel")), "key", "bin").drop("key")


@query
def diff_ms8(spark, sf):
    cells = series.local_deviation(series.difference(_hourly_rows(spark, sf)), 8, "ms8")
    return cells.select("channel", "row_idx", r6("diff"), r6("ms8"))


@query
def ms64(spark, sf):
    return series.local_deviation(_hourly_rows(spark, sf), 64, "ms64").select("channel", "row_idx", r6("ms64"))


@query
def label_runs(spark, sf):
    return runs.runs(T.event_series(spark, sf))


@query
def label_onset_cut(spark, sf):
    return runs.onset_cut(T.event_series(spark, sf), 1).select("series_id", "row_idx", "label")


@query
def label_context_fix(spark, sf):
    return runs.context_fix(T.event_series(spark, sf), onset=2, most=6).select("series_id", "row_idx", "label")


@query
def normal_reference(spark, sf):
    return runs.normal_reference(T.event_series(spark, sf), least=4, most=6)


@query
def row_targets(spark, sf):
    cells = T.hourly_cells(spark, sf).select("bin", "series_id", F.when(F.col("n") % 4 == 0, 1).when(F.col("n") % 5 == 0, -1).otherwise(0).alias("label"))
    return labels.row_targets(cells, ("bin",))


@query
def supervision_weights(spark, sf):
    docs, marks = T.table(spark, sf, "documents").select("doc_id", "source"), T.table(spark, sf, "labels")
    cells = docs.join(marks, "doc_id", "left").select(F.col("source").alias("series_id"), F.col("doc_id").alias("row_idx"), F.coalesce("toxic", F.lit(-1)).cast("int").alias("label"))
    level = F.when(F.col("row_idx") % 2 == 0, "row").otherwise("cell")
    conf = C.label_confidence(F.lit(None).cast("double"), F.when(F.col("row_idx") % 3 == 0, "weak").when(F.col("row_idx") % 3 == 1, "predictive").otherwise("source"))
    return labels.supervision(cells, conf, level).select(F.col("row_idx").alias("doc_id"), "target", "weight", "row_weight")


@query
def label_audit(spark, sf):
    return runs.audit(T.event_series(spark, sf), longest=3, share=0.2, most=6).withColumn("ratio", F.round("ratio", 6))


@query
def label_audit_summary(spark, sf):
    audited = runs.audit(T.event_series(spark, sf), longest=3, share=0.2, most=6).withColumn("grp", F.pmod("series_id", F.lit(7)))
    return runs.audit_summary(audited, "grp").withColumn("median_ratio", F.round("median_ratio", 6))


@query
def role_assignment(spark, sf):
    rows = T.event_series(spark, sf)
    catalog = rows.groupBy("series_id").agg((F.count_if(F.col("label") == 1) / F.count("*")).alias("anomaly_row_ratio"))
    source = F.concat(F.lit("s"), F.pmod("series_id", F.lit(9)))
    catalog = catalog.select(
        "series_id", (F.col("anomaly_row_ratio") * 3).alias("anomaly_row_ratio"), source.alias("source"), F.concat(F.lit("k"), F.pmod("series_id", F.lit(4))).alias("sector"),
        (F.pmod("series_id", F.lit(3)) == 0).alias("unlabeled"), F.when(F.pmod("series_id", F.lit(13)) == 0, "b").alias("benchmark"), labels.held_out(F.col("series_id")).alias("is_val"),
    )
    return labels.roles(catalog, ["s1", "s2"], ["s3"], ["k3"]).select("series_id", "role")


@query
def resample_mean(spark, sf):
    return reshape.resample_mean(T.event_series(spark, sf), 86400.0).select("series_id", "bin", r6("value"), "n")


@query
def gap_fill_grid(spark, sf):
    bins = reshape.resample_mean(T.event_series(spark, sf), 86400.0)
    return reshape.gap_fill(bins, 86400.0, 0.0).select("series_id", "bin", r6("value"))


@query
def block_downsample(spark, sf):
    return reshape.block_downsample(T.daily_series(spark, sf), 4).select("series_id", "row_idx", "timestamp", r6("value"), "label")


INTERVALS = [(1, 1704100000.0, 1704500000.0, 1), (1, 1704300000.0, 1704900000.0, -1), (2, 1704500000.0, 1704800000.0, 1), (2, 1704800000.0, 1705000000.0, -1), (3, 1.0, 2.0, 1), (4, 1705500000.0, None, 1)]


@query
def interval_label(spark, sf):
    table = spark.createDataFrame(INTERVALS, "series_id long, a double, b double, label int")
    return reshape.interval_label(T.event_series(spark, sf).drop("label"), table, "timestamp", 86400.0).select("series_id", "row_idx", "label")


@query
def asof_align(spark, sf):
    rows = T.event_series(spark, sf)
    left = rows.where("event_type = 'click'").select("series_id", "timestamp", "event_id")
    right = rows.where("event_type = 'view'").select("series_id", "timestamp", F.col("value").alias("last_view"))
    return reshape.asof_align(left, right, "series_id", "timestamp", ["last_view"]).select("event_id", "series_id", r6("last_view"))


@query
def dup_timestamp_merge(spark, sf):
    cells = gappy(T.event_series(spark, sf)).withColumn("timestamp", reshape.binned("timestamp", 43200.0)).drop("row_idx")
    return reshape.merge_duplicates(cells).select("series_id", "row_idx", "timestamp", r6("value"), "n_merged")


@query
def sliding_window_blend(spark, sf):
    each = series.in_windows(T.daily_series(spark, sf), 256, 128)
    score = each.withColumn("score", (F.col("value") + F.col("start")) / 1000)
    return series.blend(score).select("series_id", "row_idx", r6("score"), "n_windows")


def _cell_probabilities(spark, sf):
    return series.robust_normalize(T.embedding_cells(spark, sf)).withColumn("p", F.round(1 - F.exp(-F.abs("z")), 9))


def _row_scores(spark, sf, how, k):
    rows = _cell_probabilities(spark, sf).groupBy("row_idx").agg(F.collect_list("p").alias("ps"))
    return rows.select("row_idx", r6(C.row_score("ps", how, k), "score"))


@query
def row_score_topk(spark, sf):
    return _row_scores(spark, sf, "topk", 3)


@query
def row_score_max(spark, sf):
    return _row_scores(spark, sf, "max", 1)


@query
def row_score_noisy_or(spark, sf):
    return _row_scores(spark, sf, "noisy_or", 3)


@query
def combine_scales(spark, sf):
    days = T.daily_series(spark, sf).withColumn("p", F.round(F.col("value") / (F.col("value") + 500), 9))
    out = days
    for factor in (2, 4):
        coarse = reshape.block_downsample(days.drop("value").withColumnRenamed("p", "value"), factor).select("series_id", F.col("row_idx").alias(f"b{factor}"), F.col("value").alias(f"p{factor}"))
        last = coarse.groupBy("series_id").agg(F.max(f"b{factor}").alias("last"))
        out = out.join(last, "series_id").withColumn(f"b{factor}", F.least(F.floor(F.col("row_idx") / factor), F.col("last"))).drop("last").join(coarse, ["series_id", f"b{factor}"])
    made = {how: r6(C.combine_scales("p", ["p2", "p4"], how), f"c_{how}") for how in ("max", "equal", "mean")}
    return out.select("series_id", "row_idx", *made.values())


@query
def calibrate_rows(spark, sf):
    return scores(spark, sf).select("series_id", "row_idx", r6(C.calibrate("score", 2.0, -0.5), "p"))


@query
def detect_short_series(spark, sf):
    rows = T.event_series(spark, sf)
    short = series.short_scores(rows, 66)
    flags = [F.count_if(F.col("p") > C.sensitivity(0.5, s)).alias(f"n_{s}") for s in ("low", "medium", "high")]
    return short.groupBy("series_id").agg(F.count("*").alias("n"), *flags, r6(F.max("p"), "max_p"))


def _hourly_probabilities(spark, sf):
    cells = series.robust_normalize(_hourly_rows(spark, sf).drop("row_idx"))
    return cells.select("series_id", F.col("bin").cast("long").alias("timestamp"), (F.col("bin") / 3600 - 473352).cast("long").alias("row_idx"), "channel", F.round(1 - F.exp(-F.abs("z") / 2), 9).alias("p"), (F.col("channel") % 3 + 1).alias("type"))


@query
def detect_events(spark, sf):
    cells = _hourly_probabilities(spark, sf)
    return events.detected(cells, events.decide(cells, 0.6), 0.6).withColumn("confidence", r6("confidence"))


@query
def event_statistics(spark, sf):
    stats = events.statistics(_wide_events(spark, sf), window=4096)
    rounded = ["duration_share", "affected_share", "amplitude", "onset", "return_share", "variance_ratio"]
    return stats.select("series_id", "start", "duration", "n_affected", "persists", *(r6(c) for c in rounded))


def _wide_events(spark, sf):
    rows = T.daily_series(spark, sf).select("series_id", "row_idx", "value", F.when((F.col("row_idx") % 90 >= 60) & (F.col("row_idx") % 90 < 72), 1).otherwise(0).alias("label"))
    level = F.when(F.col("label") == 1, F.col("value") * 3).otherwise(F.col("value"))
    return rows.select("series_id", "row_idx", "label", F.posexplode(F.array(level, F.col("value") + F.col("row_idx") % 5)).alias("channel", "value"))


@query
def event_summary(spark, sf):
    return events.summary(events.statistics(_wide_events(spark, sf)), "series_id", 100_000).select("series_id", "events", *(F.element_at("duration", i).alias(f"d{i}") for i in (1, 2, 3)), r6("persists"), r6("calms"))


@query
def template_bank(spark, sf):
    cells = _wide_events(spark, sf)
    return events.templates(cells, events.statistics(cells)).select("series_id", "start", "channel", "place", r6("z"))


@query
def average_precision(spark, sf):
    return metrics.ranking(scores(spark, sf)).select("series_id", r6("average_precision"))


@query
def roc_auc(spark, sf):
    return metrics.ranking(scores(spark, sf)).select("series_id", r6("roc_auc"))


@query
def best_f1(spark, sf):
    return metrics.ranking(scores(spark, sf)).select("series_id", r6("best_f1"))


@query
def brier_nll(spark, sf):
    return metrics.brier_nll(scores(spark, sf)).select("series_id", "n", r6("anomaly_share"), r6("brier"), r6("nll"))


@query
def vus_pr(spark, sf):
    return metrics.range_precision(scores(spark, sf), (0, 2, 5, 9)).select("series_id", r6("vus_pr"))


@query
def source_score(spark, sf):
    each = metrics.ranking(scores(spark, sf)).select("average_precision", "roc_auc", F.pmod("series_id", F.lit(9)).alias("source"), (F.pmod("series_id", F.lit(9)) < 3).alias("unseen"))
    return metrics.source_score(each).select(r6("unseen_score"), r6("seen_score"), r6("score"))


@query
def threshold_bestf1(spark, sf):
    return metrics.best_threshold(scores(spark, sf)).select("series_id", r6("threshold"), r6("f1"))


@query
def column_volatility_topk(spark, sf):
    ranked = series.volatility(T.embedding_cells(spark, sf)).select("series_id", "channel", r6("volatility"))
    return ranked.selectExpr("*", "row_number() over (partition by series_id order by volatility desc, channel) as place").where("place <= 8")


@query
def constant_column_filter(spark, sf):
    cells = T.event_series(spark, sf)
    wide = cells.select("series_id", F.posexplode(F.array(F.col("value"), F.when(F.col("event_id") % 3 == 0, F.col("value")), F.lit(5.0))).alias("channel", "value"))
    return wide.groupBy("series_id", "channel").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("known"), F.stddev_samp("value").alias("sd")).where("known > 0.5 and sd > 0").select("series_id", "channel", r6("known"), r6("sd"))


@query
def corr_partner(spark, sf):
    cells = T.hourly_cells(spark, sf).select("series_id", F.col("bin").alias("row_idx"), "channel", F.col("n").cast("double").alias("value"))
    return series.correlated_partner(cells, 0.0).select("channel", "partner", r6("r"))


@query
def melt_pivot_last(spark, sf):
    rows = T.event_series(spark, sf).withColumn("bin", reshape.binned("timestamp", 86400.0))
    kinds = ["click", "error", "view"]
    return reshape.melt_pivot_last(rows.where(F.col("event_type").isin(kinds)), ["series_id"], "bin", "event_type", kinds, "value", F.struct("timestamp", "event_id"))


@query
def catalog_upsert(spark, sf):
    customers = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("state"))
    orders = T.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.lit("new").alias("state")).distinct()
    return reshape.upsert(customers, orders, "id")


@query
def holdout_split(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_custkey", "o_totalprice", labels.held_out(F.col("o_custkey")).alias("held"))
    return orders.groupBy("held").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


def _injected(spark, sf, kind):
    cells = T.event_series(spark, sf)
    return inject.inject(cells, kind, F.lit(10), F.lit(18), 4.0).select("series_id", "row_idx", r6("value"), "label", "type")


@query
def inject_spike(spark, sf):
    return _injected(spark, sf, "spike")


@query
def inject_level(spark, sf):
    return _injected(spark, sf, "level_shift")


@query
def inject_flatline(spark, sf):
    return _injected(spark, sf, "flatline")


@query
def inject_drift(spark, sf):
    return _injected(spark, sf, "drift")


@query
def inject_correlation_break(spark, sf):
    return _injected(spark, sf, "correlation_break")


@query
def budget_select(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return labels.budget(orders, "o_orderpriority", "size", [F.col("o_orderkey")], 5_000_000).select("o_orderpriority", "o_orderkey", "running")


@query
def snapshot_features(spark, sf):
    items = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.lit(0).alias("channel"), F.col("l_quantity").cast("double").alias("value"))
    return series.snapshot(items).select("series_id", r6("rms"), "peak", r6("kurtosis"))


@query
def seasonal_features(spark, sf):
    rows = T.event_series(spark, sf)
    return rows.select("event_id", r6(C.hour("timestamp"), "hour"), C.weekday("timestamp").alias("weekday"), r6(C.year_share("timestamp"), "year_share"), r6(C.bump(C.hour("timestamp"), F.lit(20.0), F.lit(2.0), F.lit(24.0)), "evening"))


@query
def eval_crop(spark, sf):
    return labels.crop(T.event_series(spark, sf), 30).select("series_id", "row_idx", "label")


@query
def losses(spark, sf):
    known = scores(spark, sf).where("label >= 0")
    return known.groupBy("series_id").agg(r6(F.avg(C.binary_loss("score", "label")), "bce"), r6(F.avg(C.focal_loss("score", "label")), "focal"))


@query
def row_metrics(spark, sf):
    out = metrics.row_metrics(scores(spark, sf))
    return out.select("series_id", "n", *(r6(c) for c in ("anomaly_share", "brier", "nll", "average_precision", "roc_auc", "best_f1", "vus_pr")))


@query
def event_bins(spark, sf):
    """Minute-like bins of a log: all rows, conditional counts, any alert, empty bins as 0."""
    rows = T.event_series(spark, sf).withColumn("bin", reshape.binned("timestamp", 3600.0))
    bins = rows.groupBy("bin").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"), F.max((F.col("value") > 400).cast("int")).alias("alert")).withColumn("series_id", F.lit(0))
    full = reshape.grid(bins, 3600.0, ("series_id",)).join(bins, ["series_id", "bin"], "left")
    return full.na.fill(0).select("bin", "total", "errors", "views", "alert")


@query
def matrix_profile(spark, sf):
    return scoring.matrix_profile(T.daily_series(spark, sf)).select("series_id", "row_idx", r6("score"))


@query
def frozen_reference_fold(spark, sf):
    return scoring.frozen_reference(_hourly_rows(spark, sf).withColumn("series_id", F.col("channel").cast("long")), size=128).select("series_id", "row_idx", r6("p"))


@query
def detect_rows(spark, sf):
    cells = T.event_series(spark, sf).select("series_id", "timestamp", "channel", "value")
    rows, _ = scoring.detect(cells, threshold=0.3)
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("anomaly").alias("n_anomalies"), r6(F.max("score"), "top"))


@query
def detect_calibrated(spark, sf):
    cells = T.event_series(spark, sf).select("series_id", "timestamp", "channel", "value")
    low, high = (scoring.detect(cells, threshold=0.3, level=level, temperature=1.5, bias=0.2).rows for level in ("low", "high"))
    low, high = (rows.groupBy("series_id").agg(F.sum("anomaly").alias(name)) for rows, name in ((low, "n_low"), (high, "n_high")))
    return low.join(high, "series_id")


@query
def multi_scale_scores(spark, sf):
    cells = T.daily_series(spark, sf)
    return scoring.score_cells(cells, scales=(4, 16), max_t=1000).select("series_id", "row_idx", "channel", r6("p"))


@query
def calibration_fit(spark, sf):
    temperature, bias = metrics.fit_calibration(scores(spark, sf))
    return spark.createDataFrame([(float(temperature), float(bias))], "temperature double, bias double")


@query
def generated_series(spark, sf):
    made = generate.generate(spark, 60, rows=256)
    return made.groupBy("domain").agg(F.countDistinct("sample").alias("samples"), F.count_if(F.col("label") == 1).alias("anomalous"), F.countDistinct("type").alias("types"))


@query
def source_quality(spark, sf):
    """Whether a source looks made up: rows by hour of day, spread of gaps, autocorrelation of hourly volume."""
    rows = T.event_series(spark, sf)
    # A few types hold all rows.
    placed = scans.numbered(rows.select("event_type", "timestamp", "event_id"), ("event_type",), ["timestamp", "event_id"])
    gaps = scans.previous(placed, ["timestamp"], ("event_type",)).withColumn("gap", F.col("timestamp") - F.col("previous_timestamp"))
    spread = gaps.groupBy("event_type").agg(F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("gap_variation"))
    hours = rows.groupBy("event_type", reshape.binned("timestamp", 3600.0).alias("bin")).agg(F.count("*").alias("n"))
    full = reshape.grid(hours, 3600.0, ("event_type",)).join(hours, ["event_type", "bin"], "left").na.fill(0, ["n"])
    lagged = full.selectExpr("event_type", "n", "lag(n) over (partition by event_type order by bin) as before")
    auto = lagged.groupBy("event_type").agg(F.corr("n", "before").alias("volume_autocorrelation"))
    of_day = rows.groupBy("event_type", F.floor(C.hour("timestamp")).alias("h")).agg(F.count("*").alias("n")).groupBy("event_type").agg((F.max("n") / F.avg("n")).alias("peak_hour"))
    return spread.join(auto, "event_type").join(of_day, "event_type").select("event_type", *(r6(c) for c in ("mean_gap", "gap_variation", "volume_autocorrelation", "peak_hour")))


@query
def corr_graph_reach(spark, sf):
    """Channels reachable along strong correlations: the closure of the coupling graph."""
    cells = T.hourly_cells(spark, sf).select("series_id", (F.col("bin") / 3600).cast("long").alias("row_idx"), "channel", F.col("n").cast("double").alias("value"))
    return graph.closure(series.correlated_partner(cells, 0.0).select(F.col("channel").alias("a"), F.col("partner").alias("b")))


@query
def first_positive_rows(spark, sf):
    return label_rules.first_positives(T.event_series(spark, sf), 3, F.pmod("series_id", F.lit(5)) == 0).select("series_id", "row_idx", "label")


@query
def first_rows_of_runs(spark, sf):
    return runs.first_rows(T.event_series(spark, sf), 2).select("series_id", "row_idx", "label")


@query
def status_log_labels(spark, sf):
    rows = T.event_series(spark, sf)
    log = rows.where("event_id % 50 = 0").select("series_id", F.col("timestamp").alias("start"), F.when(F.col("event_id") % 100 == 0, F.col("timestamp") + 90000.0).alias("stop"), "event_type")
    out = label_rules.status_labels(rows.select("series_id", "row_idx", "timestamp"), log, F.col("event_type") == "error", F.col("event_type") == "view")
    return out.select("series_id", "row_idx", "label")


@query
def train_part_unknown(spark, sf):
    return label_rules.half_known(T.event_series(spark, sf)).select("series_id", "row_idx", "label")


@query
def outer_align(spark, sf):
    """Two channels on the union of their times."""
    rows = T.hourly_cells(spark, sf)
    a, b = (rows.where(F.col("channel") == c).select("bin", F.col("value").alias(n)) for c, n in ((1, "error"), (3, "signup")))
    return a.where("bin % 7200 = 0").join(b.where("bin % 10800 = 0"), "bin", "full_outer").select("bin", r6("error"), r6("signup"))


@query
def positional_join(spark, sf):
    """Labels of one table put to the rows of another by position; rows beyond the labels are unknown."""
    rows = T.daily_series(spark, sf).select("series_id", "row_idx", "value")
    marks = T.event_series(spark, sf).groupBy("row_idx").agg(F.max("label").alias("label"))
    return rows.join(marks, "row_idx", "left").select("series_id", "row_idx", F.coalesce("label", F.lit(-1)).alias("label"))


@query
def smallest_of_group(spark, sf):
    """The smallest item of each group, its class by the first pattern that matches its name."""
    from ..sources.raw import smallest_files

    parts = T.table(spark, sf, "part").select(F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("solar_power", "taxi_", "era5_1999", "x solar_power", "m4_"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_brand")).alias("subset"), F.col("p_name").alias("file"), F.col("p_partkey").alias("size"))
    return smallest_files(parts)


@query
def role_counts(spark, sf):
    roles = role_assignment(spark, sf)
    return roles.groupBy("role").agg(F.count("*").alias("n"), F.min("series_id").alias("first"))


@query
def per_source_subset(spark, sf):
    """At most three series a group, by id."""
    rows = T.event_series(spark, sf).select("series_id", F.pmod("series_id", F.lit(11)).alias("source")).distinct()
    return rows.selectExpr("*", "row_number() over (partition by source order by series_id) as place").where("place <= 3")


def _windows(spark, sf, size):
    """Rows of the event series in windows that follow each other, with a channel of gaps and a constant one."""
    rows = T.event_series(spark, sf).withColumn("window", F.floor(F.col("row_idx") / size))
    channels = F.array(F.col("value"), F.when(F.col("event_id") % 3 == 0, F.col("value")), F.lit(5.0))
    return rows.select("series_id", "window", "row_idx", "label", F.posexplode(channels).alias("channel", "value"))


@query
def usable_window_channels(spark, sf):
    out = labels.usable_channels(_windows(spark, sf, 6))
    return out.groupBy("series_id", "window", "channel").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


@query
def dense_window_reject(spark, sf):
    out = labels.without_dense(_windows(spark, sf, 3), F.pmod("series_id", F.lit(3)) == 0)
    return out.groupBy("series_id", "window").agg(F.countDistinct("row_idx").alias("n_rows"))


@query
def learned_sources(spark, sf):
    """Whose labels may be used, and under which name a series is reported."""
    names = F.array(*map(F.lit, ("hai", "cats", "ucr", "lead", "w3", "esa")))
    paths = F.array(*map(F.lit, ("hai-20.07/test", "hai-22.04/test", "x/train", "train/x", "ECG1", "hai-21.03/train", None)))
    part = T.table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("source"), F.element_at(paths, (F.col("p_partkey") % 7 + 1).cast("int")).alias("path"))
    return part.select("p_partkey", labels.learned_from(F.col("source"), F.col("path")).alias("learned"), labels.reported_source(F.col("source"), F.col("path")).alias("source"))


@query
def aggregation_choice(spark, sf):
    """Ways to aggregate a row's cells, compared by source score; the first stays unless another is clearly better."""
    ways = {"max": ("max", 1), "noisy_or3": ("noisy_or", 3), "topk3": ("topk", 3)}
    lists = _cell_probabilities(spark, sf).groupBy("row_idx").agg(F.collect_list("p").alias("ps"))  # a row's channels
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("way"), r6(C.row_score("ps", how, k), "score")) for w, (how, k) in ways.items())))
    rows = lists.select("row_idx", each.alias("s")).select("row_idx", "s.way", "s.score", (F.col("row_idx") % 12).alias("series_id"), (F.col("row_idx") % 7 == 0).cast("int").alias("label"))
    found = metrics.ranking(rows, ("way", "series_id")).withColumn("source", F.col("series_id") % 4).withColumn("unseen", F.col("source") < 2)
    return metrics.compared(found, base="max").select("way", r6("unseen_score"), r6("seen_score"), r6("score"), "chosen")


@query
def benchmark_table(spark, sf):
    """Metrics by source, against the plain average precision of some of the sources."""
    each = metrics.row_metrics(scores(spark, sf)).withColumn("source", F.pmod("series_id", F.lit(9)))
    out = metrics.benchmark(each, each.where("source > 1").select("source", F.col("average_precision").alias("vus_pr")))
    return out.select("source", "n_series", *(r6(c) for c in ("anomaly_share", "average_precision", "vus_pr", "roc_auc", "best_f1", "brier", "nll", "chance", "gain")))


@query
def false_alarm_channels(spark, sf):
    row = F.col("row_idx")
    cells = _cell_probabilities(spark, sf).withColumn("label", F.when(row % 7 == 0, 1).when(row % 5 == 0, -1).otherwise(0))
    return metrics.false_alarms(cells).select("series_id", "channel", r6("rate"), "place")


@query
def inject_template(spark, sf):
    """A real event, a quarter or half as long, in the series of events."""
    wide = written(_wide_events(spark, sf), "days")
    stats = written(events.statistics(wide), "statistics")
    bank = written(events.templates(wide, stats).where("series_id = 'A' and start = 60").withColumn("z", r6("z")), "bank")
    cells = selection.dealt(written(T.event_series(spark, sf), "cells"), ("series_id",))
    placed = cells.select("series_id").distinct().select(
        "series_id", F.lit("A").alias("template"), F.lit(60).alias("template_start"), (5 + F.pmod("series_id", F.lit(3))).alias("start"),
        F.when(F.pmod("series_id", F.lit(2)) == 0, 0.25).otherwise(0.5).alias("stretch"), F.lit(1.5).alias("gain"),
    )
    return inject.from_template(cells, bank, placed).select("series_id", "row_idx", r6("value"), "label", "type")


@query
def weighted_series_pick(spark, sf):
    """Three customers a segment, likelier the larger their balance."""
    rows = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").cast("double").alias("size"))
    drawn = (F.pmod(F.col("series_id") * 7919, F.lit(1009)) + 1) / 1009
    return labels.weighted_pick(rows, "sector", F.when(F.col("size") > 0, F.sqrt("size")), drawn, 3).select("series_id", "sector", r6("size"))


@query
def random_drop(spark, sf):
    """Two of three rows and the times between those that stay."""
    rows = T.event_series(spark, sf)
    few = labels.thinned(rows, 2 / 3, F.pmod(F.col("event_id") * 31 + F.col("series_id"), F.lit(97)) / 97)
    return series.delta_t(few).select("series_id", "row_idx", "label", r6("delta_t"))


@query
def one_series_scans(spark, sf):
    """Scans over the table as one series, in blocks of 4,096 rows: last known value, difference, runs, and running totals."""
    keys, size = ("series_id",), 4_096
    rows = written(scans.last_known(gappy(T.one_series(spark, sf)), "value", keys, "filled", size), "filled")
    rows = written(scans.previous(rows, ["filled", "timestamp"], keys, size), "steps")
    rows = written(scans.run_starts(rows, 1, keys, size), "runs")
    totals = {"anomalies": ("sum", (F.col("label") == 1).cast("long")), "growth": ("product", 1 + F.col("value") * 1e-6), "highest": ("max", "value"), "lowest": ("min", "value")}
    rows = scans.running(rows, totals, keys, size)
    steps = (r6(F.col("filled") - F.col("previous_filled"), "diff"), r6(F.col("timestamp") - F.col("previous_timestamp"), "step"))
    return rows.select("row_idx", r6("filled"), *steps, "run_start", "anomalies", r6("growth"), r6("highest"), r6("lowest"))


@query
def one_series_repairs(spark, sf):
    """The label repairs and the filled, scaled values of the table as one series."""
    rows = written(gappy(T.one_series(spark, sf)), "one-series")
    fixed = runs.context_fix(rows.select("series_id", "row_idx", "label"), onset=2, most=200).select("series_id", "row_idx", "label")
    filled = written(series.fill(rows.drop("label")).drop("value").withColumnRenamed("filled", "value"), "filled")
    return series.robust_normalize(filled).join(fixed, ["series_id", "row_idx"]).select("row_idx", "label", r6("z"))


@query
def channel_quantiles(spark, sf):
    """Exact quantiles of whole columns, each a channel: continuous, tied, and with both signs."""
    items = T.table(spark, sf, "lineitem")
    values = {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "balance": (F.col("l_extendedprice") - 30000) * (1 - F.col("l_discount"))}
    cells = items.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("double") for v in values.values())))).alias("channel", "value"))
    found = selection.selected(cells, ("channel",), "value", {"low": 0.1, "middle": 0.5, "high": 0.9, "least": 0.0, "most": 1.0})
    return found.select("channel", *(r6(c) for c in ("low", "middle", "high", "least", "most")))


@query
def result_frame(spark, sf):
    """What a user gets for each row: its time, values, score and verdict."""
    cells = T.event_series(spark, sf).select("series_id", "timestamp", "channel", "value")
    return scoring.detect(cells, threshold=0.3).frame([0]).select("series_id", "row_idx", r6("timestamp"), r6("ch_0"), r6("score"), "anomaly")


@query
def window_scores(spark, sf):
    """Overlapping windows, each scaled by itself, their scores blended."""
    return windows.window_scores(T.daily_series(spark, sf), 512, 256).select("series_id", "row_idx", "channel", r6("p"))


@query
def scales_with_reference(spark, sf):
    """Scores against the first 200 days, on days and on means of four of them."""
    cells = T.daily_series(spark, sf)
    normal = cells.where("row_idx < 200").select("series_id", "row_idx", "channel", "value")
    return scoring.score_cells(cells, scoring.windowed_scorer(1000), scales=(4,), max_t=1000, normal=normal).select("series_id", "row_idx", "channel", r6("p"))


@query
def interval_cell_labels(spark, sf):
    """Cells of hourly series by intervals and the channels they name; marked hours that none reaches count for all channels."""
    hours = T.hourly_cells(spark, sf).groupBy("series_id", F.col("bin").alias("timestamp")).agg(F.max(F.when(F.col("n") % 7 == 0, 1).otherwise(0)).alias("marked"))
    faults = T.table(spark, sf, "events").where("event_type = 'error'").select(F.lit(0).alias("series_id"), C.unix_seconds("ts").alias("a"), "event_id", "user_id")
    channels = F.array_distinct(F.array(F.lit(1), (F.col("user_id") % 5).cast("int"), (F.col("event_id") % 5).cast("int")))
    spans = faults.select("series_id", "a", (F.col("a") + 600.0 * (F.col("event_id") % 11)).alias("b"), channels.alias("channels"))
    known = reshape.interval_channels(hours, spans, "timestamp", 86400.0)
    cells = known.withColumn("channel", F.explode(F.array(*map(F.lit, range(5)))))
    label = F.when(F.size("channels") > 0, F.array_contains("channels", F.col("channel")).cast("int")).otherwise(F.col("marked"))
    return cells.select("timestamp", "channel", label.alias("label"))


@query
def buyer_reach(spark, sf):
    """From each customer along chains: whose latest order leads to which customers, by order numbers; a graph with long paths."""
    orders = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("a")).agg(F.max("o_orderkey").alias("k"))
    edges = orders.where("a % 10 < 8").select("a", (F.col("a") + 1 + F.col("k") % 3).alias("b"))
    return graph.closure(edges).groupBy("a").agg(F.count("*").alias("reached"), F.max("b").alias("furthest"))


@query
def channel_correlations(spark, sf):
    """All pairs of the 64 channels of each label's vectors."""
    return series.correlations(T.embedding_cells(spark, sf)).select("series_id", "channel", "partner", r6("r"), "n")


def _orders_catalog(spark, sf):
    """Each customer as a series of a segment: as many rows as orders, channels by key."""
    orders = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg((F.count("*") * 30).alias("n_rows"))
    rows = orders.join(T.table(spark, sf, "customer"), F.col("series_id") == F.col("c_custkey"))
    level = F.when(F.col("series_id") % 3 == 0, "row").otherwise("cell")
    return rows.select("series_id", F.col("c_mktsegment").alias("sector"), "n_rows", (1 + F.col("series_id") % 9).cast("int").alias("n_channels"), level.alias("label_level"))


@query
def training_draws(spark, sf):
    """A draw for each order: its sector, series, and what is cut from it, by numbers made of its key."""
    salts = {"group": 1, "row": 2, "factor": 3, "length": 4, "whole": 5, "start": 6, "channels": 7}
    draw = lambda choice: F.pmod(F.col("item") * 7919 + salts[choice] * 104729, F.lit(10007)) / 10007
    items = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    drawn = sampling.weighted_draws(items, _orders_catalog(spark, sf), "sector", F.floor(F.sqrt("n_rows")), draw)
    return sampling.placed(drawn, draw, max_t=200, min_t=20).select("item", "sector", "series_id", "factor", "length", "start", "channels")


@query
def batches_by_size(spark, sf):
    """Orders in batches whose padded size is within a budget."""
    items = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("n_rows"), F.count("*").alias("n_channels"))
    return sampling.bucketed(items, "n_rows", "n_channels", 20_000)


@query
def inject_variants(spark, sf):
    """The further forms of faults, put in the same rows of daily series."""
    cells = T.daily_series(spark, sf)
    noise = 2 * F.sin(F.col("row_idx") * 12.9898)
    parts = [
        inject.inject(cells, kind, F.lit(100), F.lit(140), 4.0, variant, noise).select(F.lit(variant).alias("variant"), "series_id", "row_idx", r6("value"), "label", "type")
        for kind, variants in inject.VARIANTS.items() for variant in variants if variant != "inverted"
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def inject_inverted(spark, sf):
    """A channel that follows its partner upside down for a while."""
    return inject.inject(_wide_events(spark, sf), "correlation_break", F.lit(100), F.lit(140), 4.0, "inverted").select("series_id", "row_idx", "channel", r6("value"), "label", "type")


@query
def cell_context_fix(spark, sf):
    """The context rule on cells of two channels: decided by row, done to anomalous cells."""
    rows = T.event_series(spark, sf)
    both = F.array(F.col("label"), F.when(F.col("event_id") % 3 == 0, F.col("label")).otherwise(0))
    cells = rows.select("series_id", "row_idx", F.posexplode(both).alias("channel", "label"))
    return runs.context_fix_cells(cells, onset=2, most=6).select("series_id", "row_idx", "channel", "label")


@query
def parsed_times(spark, sf):
    """Series timed in seconds or milliseconds, told apart by their typical time."""
    rows = T.event_series(spark, sf)
    t = F.when(F.col("series_id") % 2 == 0, F.round(F.col("timestamp") * 1000)).otherwise(F.floor("timestamp"))
    return reshape.unix_times(rows.withColumn("timestamp", t.cast("double"))).select("event_id", r6("timestamp"))


@query
def real_event_table(spark, sf):
    """Measures of events by source, of those series whose labels may be learned from."""
    cells = _wide_events(spark, sf)
    source = F.when(F.col("series_id") == "A", "lead").when(F.col("series_id") == "R", "kelmarsh").otherwise("hai")
    catalog = cells.select("series_id").distinct().select("series_id", source.alias("source"), F.lit(False).alias("unlabeled"), F.lit("row").alias("label_level"))
    table = events.by_source(events.real_events(cells, catalog))
    return table.select("source", "events", *(r6(c) for c in ("duration", "amplitude", "onset", "affected_share", "calms", "persists")))
