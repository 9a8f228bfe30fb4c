"""Detected events and the statistics of labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import calibrate, clip, row_score, sensitivity
from ..schema import MAX_T, TYPES
from . import runs
from .labels import learned_from


def decide(cells: DataFrame, threshold: float, level: str = "medium", how: str = "topk", k: int = 3, temperature: float = 1.0, bias: float = 0.0, plain: str | None = None) -> DataFrame:
    """``series_id, row_idx, score, anomaly`` from cell probabilities ``p``: row score, calibration, threshold (exclusive). Rows whose
    cells have ``plain`` set aren't calibrated."""
    mark = F.lit(False) if plain is None else F.max(plain)
    rows = cells.groupBy("series_id", "row_idx").agg(row_score(F.collect_list("p"), how, k).alias("raw"), mark.alias("plain_"))  # bounded by the channels
    score = F.when(F.col("plain_"), F.col("raw")).otherwise(calibrate("raw", temperature, bias))
    return rows.select("series_id", "row_idx", score.alias("score")).withColumn("anomaly", (F.col("score") > sensitivity(threshold, level)).cast("int"))


def detected(cells: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """One row an event, a run of anomalous rows: ``start, stop`` (inclusive), times, channels, type, confidence, reason.

    Its channels are those of cells above the threshold; without any, of each row's strongest cell. ``cells`` has
    ``series_id, row_idx, channel, timestamp, p`` and ``type`` (an id; 0 throughout an event: just an anomaly).
    """
    flagged = rows.withColumnRenamed("anomaly", "label")
    spans = runs.islands(flagged).select("series_id", "row_idx", "run", "score")
    inside = cells.join(spans, ["series_id", "row_idx"])
    run = Window.partitionBy("series_id", "run")
    row = Window.partitionBy("series_id", "row_idx")
    over = F.col("p") > threshold
    strongest = F.col("p") == F.max("p").over(row)
    marked = inside.withColumn("over", over).withColumn("strongest", strongest).withColumn("any", F.max(over.cast("int")).over(run) == 1)
    used = marked.withColumn("used", F.when(F.col("any"), F.col("over")).otherwise(F.col("strongest")))
    kinds = used.where("used").groupBy("series_id", "run", "type").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("series_id", "run").agg(F.max_by("type", F.struct("n", -F.col("type"))).alias("type"), F.max("type").alias("most"))
    spans = used.groupBy("series_id", "run").agg(
        F.min("row_idx").alias("start"), F.max("row_idx").alias("stop"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("stop_time"),
        F.array_sort(F.collect_set(F.when(F.col("used"), F.col("channel")))).alias("channels"), F.max("score").alias("confidence"),
    )
    names = F.create_map(*(x for i, t in enumerate(TYPES) for x in (F.lit(i), F.lit(t))))
    reason = F.format_string("%d channels deviate over %d rows", F.size("channels"), F.col("stop") - F.col("start") + 1)
    return spans.join(kind, ["series_id", "run"]).select("series_id", "start", "stop", "start_time", "stop_time", F.when(F.col("most") > 0, names[F.col("type")]).otherwise("anomaly").alias("type"), F.array_join("channels", ",").alias("channels"), "confidence", reason.alias("reason"))


def _mad(values, centre):
    return F.median(F.abs(values - centre)) * 1.4826 + 1e-9


def within(cells: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Cells with the events whose rows from ``low`` up to ``high`` they are among, by an equi-join on the series and bins
    of ``width`` rows: a long series is many keys, and an event meets its own bins only."""
    bins = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    spread = events.where("low < high").withColumn("bin", F.explode(bins))
    return cells.withColumn("bin", F.floor(F.col("row_idx") / width)).join(spread, ["series_id", "bin"]).where("row_idx >= low and row_idx < high").drop("bin")


def statistics(cells: DataFrame, least_before: int = 16, least_after: int = 8, window: int = MAX_T, by_cell: bool = False) -> DataFrame:
    """One row a labelled event with its measures against the rows before and after it.

    The rows before reach back ``max(32, 2 * length)``; events over ``window`` rows, or with fewer than ``least_before``
    rows before them, don't count. By channel: ``a`` median deviation in units of the spread before, ``onset`` share of the
    event until half of it is reached, ``variance`` ratio of spreads, ``returns`` whether the rows after lie within one unit.
    ``cells``: ``series_id, row_idx, channel, value`` and the row's ``label``; with ``by_cell`` each cell's own: a row is then anomalous if any
    cell is, and an event's channels are those with an anomalous cell in it, still as a share of all.
    """
    rows = cells.groupBy("series_id", "row_idx").agg(F.max("label").alias("label"))
    lengths = rows.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n"))
    events = runs.runs(rows).join(lengths, "series_id").where(F.col("length") <= window)
    before = F.greatest(F.lit(0), F.col("start") - F.greatest(F.lit(32), 2 * F.col("length")))
    events = events.withColumn("low", before).where(F.col("start") - F.col("low") >= least_before).withColumn("high", F.least(F.col("n"), F.col("stop") + 2 * F.col("length")))
    near = within(cells.drop("label"), events, window)
    key = ["series_id", "start", "channel"]
    phase = F.when(F.col("row_idx") < F.col("start"), "pre").when(F.col("row_idx") < F.col("stop"), "event").otherwise("post")
    tagged = near.withColumn("phase", phase)
    v = F.col("value")
    pick = lambda name: F.when(F.col("phase") == name, v)
    # A group has at most five lengths of one event's rows.
    centre = tagged.groupBy(*key).agg(F.median(pick("pre")).alias("m0"), F.median(pick("event")).alias("me"), F.median(pick("post")).alias("mp"), F.count(pick("pre")).alias("n_pre"), F.count(pick("event")).alias("n_event"), F.count_if(F.col("phase") == "post").alias("n_post"))
    spread = tagged.join(centre, key).groupBy(*key).agg(
        *(F.first(c).alias(c) for c in ("m0", "mp", "n_pre", "n_event", "n_post", "length", "stop", "n")),
        _mad(pick("pre"), F.col("m0")).alias("sd0"), _mad(pick("event"), F.col("me")).alias("sde"),
    ).where("n_pre >= 4")
    d = F.abs((v - F.col("m0")) / F.col("sd0"))
    inside = tagged.where("phase = 'event'").select(*key, "row_idx", "value").join(spread, key).withColumn("d", d)
    amplitude = inside.groupBy(*key).agg(F.median("d").alias("a"))
    reached = inside.join(amplitude, key).where("a > 0.5 and d >= a / 2").groupBy(*key).agg((F.min(F.col("row_idx") - F.col("start")) / F.first("length")).alias("onset"))
    per = spread.join(amplitude, key).join(reached, key, "left")
    total = F.count("*")
    if by_cell:
        hit = within(cells.where("label = 1").select("series_id", "row_idx", "channel"), events.select("series_id", "start", F.col("start").alias("low"), F.col("stop").alias("high")), window)
        width = cells.groupBy("series_id").agg(F.count_distinct("channel").alias("width"))
        per, total = per.join(hit.select(*key).distinct(), key, "left_semi").join(width, "series_id"), F.first("width")
    variance = F.when(F.col("n_event") >= 4, F.col("sde") / F.col("sd0"))
    returns = F.when(F.col("n_post") >= least_after, (F.abs(F.col("mp") - F.col("m0")) / F.col("sd0") < 1).cast("double"))
    out = per.withColumn("variance", variance).withColumn("returns", returns).groupBy("series_id", "start").agg(
        F.first("length").alias("duration"), F.first("stop").alias("stop"), F.first("n").alias("n"), total.alias("n_channels"),
        F.count_if(F.col("a") >= 0.5).alias("n_affected"), F.median(F.when(F.col("a") >= 0.5, F.col("a"))).alias("strong"), F.median("a").alias("typical"),
        F.median("onset").alias("onset"), F.avg("returns").alias("return_share"), F.median("variance").alias("variance_ratio"),
    )
    return out.select(
        "series_id", "start", "duration", (F.col("duration") / window).alias("duration_share"), "n_affected", (F.col("n_affected") / F.col("n_channels")).alias("affected_share"),
        F.coalesce("strong", "typical").alias("amplitude"), "onset", (F.col("stop") >= F.col("n") - 1).alias("persists"), "return_share", "variance_ratio",
    )


def real_events(cells: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """Statistics of the labelled events that may be learned from, with their ``source``: of series of the sources and names that
    ``labels.learned_from`` allows, by cell where their labels are. ``catalog``: ``series_id, source, unlabeled, label_level``."""
    may = catalog.where(~F.col("unlabeled") & learned_from(F.col("source"), F.col("series_id"))).select("series_id", "source", "label_level")
    parts = [statistics(cells.join(may.where(level), "series_id", "left_semi"), by_cell=by_cell, **options) for by_cell, level in ((True, "label_level = 'cell'"), (False, "label_level <> 'cell'"))]
    return parts[0].unionByName(parts[1]).join(may.select("series_id", "source"), "series_id")


def by_source(stats: DataFrame) -> DataFrame:
    """By ``source``: events, medians of duration, amplitude, onset and affected share, share of events that calm, and of those that stay to the end."""
    return stats.groupBy("source").agg(
        F.count("*").alias("events"), F.median("duration").alias("duration"), F.median("amplitude").alias("amplitude"), F.median("onset").alias("onset"), F.median("affected_share").alias("affected_share"),
        F.avg(F.coalesce(F.col("variance_ratio") < 0.5, F.lit(False)).cast("double")).alias("calms"), F.avg(F.col("persists").cast("double")).alias("persists"),
    )


def summary(stats: DataFrame, by: str, most: int = 150) -> DataFrame:
    """Quantiles of the measures over at most ``most`` events a group (the feature: groups weigh alike), those of least hash."""
    some = stats.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("series_id", "start")))).where(F.col("place") <= most)
    q = lambda c: F.transform(F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))), lambda x: F.round(x, 2)).alias(c)
    return some.groupBy(by).agg(F.count("*").alias("events"), q("duration"), q("amplitude"), q("onset"), F.avg(F.col("persists").cast("double")).alias("persists"), F.avg((F.col("variance_ratio") < 0.5).cast("double")).alias("calms"))


def templates(cells: DataFrame, stats: DataFrame, least: int = 8, most: int = 2048, limit: float = 30.0) -> DataFrame:
    """The template bank: each usable event's rows with twice its length before and after, scaled by the rows before.

    ``series_id, start, length, channel, place, z``; channels with a vanishing spread before, or affected by less than
    half of it, are left out.
    """
    usable = stats.where(F.col("duration").between(least, most) & (F.col("amplitude") >= 0.5)).select("series_id", F.col("start"), F.col("duration").alias("length"))
    bounds = usable.withColumn("low", F.greatest(F.lit(0), F.col("start") - 2 * F.col("length"))).withColumn("high", F.col("start") + 3 * F.col("length"))
    near = within(cells, bounds, MAX_T).drop("low", "high")
    key = ["series_id", "start", "channel"]
    pre = F.when(F.col("row_idx") < F.col("start"), F.col("value"))
    centre = near.groupBy(*key).agg(F.median(pre).alias("m0"))
    spread = near.join(centre, key).groupBy(*key).agg(F.first("m0").alias("m0"), _mad(pre, F.col("m0")).alias("sd0")).where("sd0 > 1e-8")
    z = clip((F.col("value") - F.col("m0")) / F.col("sd0"), -limit, limit)
    scaled = near.join(spread, key).withColumn("z", z)
    affected = scaled.where("row_idx >= start and row_idx < start + length").groupBy(*key).agg(F.median(F.abs("z")).alias("a")).where("a >= 0.5").select(*key)
    return scaled.join(affected, key, "left_semi").select(*key, "length", (F.col("row_idx") - F.col("start")).alias("place"), "z")
