"""Faults put into a known stretch of a series, as expressions over the row index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TYPES
from ..storage import written
from . import selection
from .series import centre_and_scale, correlated_partner

#: Share of the injected cells' spread that a fault has to move them by.
LEAST_EFFECT = 0.3


#: Variants of the kinds of faults; a kind's plain form has none.
VARIANTS = {"level_shift": ("subtle",), "flatline": ("noisy", "stuck"), "drift": ("linear", "worn"), "noise_burst": ("ramped", "collapse"), "correlation_break": ("inverted",)}


def hashed_noise() -> Column:
    """A standard normal number for each cell, by hash."""
    u = [(F.pmod(F.xxhash64("series_id", "channel", "row_idx", F.lit(k)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1) for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def _medians(cells: DataFrame, where: Column, name: str) -> DataFrame:
    """Medians over the fault's stretch, which a task can hold."""
    return cells.where(where).groupBy("series_id", "channel").agg(F.median("value").alias(name))


def inject(cells: DataFrame, kind: str, start: Column, stop: Column, strength: float, variant: str | None = None, noise: Column | None = None) -> DataFrame:
    """``cells`` with the fault on rows ``[start, stop)`` of each channel: ``value, label`` (1 there), ``type``.

    ``spike`` a single row in the middle; ``level_shift`` by ``strength`` spreads; ``flatline`` holds the first row's value;
    ``drift`` grows to ``strength`` spreads; ``noise_burst`` alternates; ``pattern_change`` a sine about the median;
    ``correlation_break`` the channel's own stretch of the same length before, after it where too few rows are before (rows
    without such a value keep theirs); ``missing_data`` nulls. Variants: ``level_shift`` ``subtle`` by 0.8 to 1.8 spreads,
    whatever the strength; ``flatline`` ``noisy`` holds with a fiftieth of a spread of ``noise``, ``stuck`` at the channel's 95 % quantile with
    three hundredths; ``drift`` ``linear``, or ``worn``: half as far, with growing noise; ``noise_burst`` ``ramped``: noise from a tenth to half of the strength,
    ``collapse``: a fourteenth of the stretch's deviation about the median of the rows before; ``correlation_break`` ``inverted``: the most correlated channel's
    stretch, turned over and scaled (channels without a partner keep theirs). ``noise`` (default: by hash of the cell) is a number a cell. Channels on which the fault moves cells by less than ``LEAST_EFFECT`` spreads are given
    back unchanged, labels included.
    """
    if kind not in TYPES[1:] or variant is not None and variant not in VARIANTS.get(kind, ()):
        raise ValueError(f"unknown fault {kind!r}" if variant is None else f"unknown variant {variant!r} of {kind!r}")
    stats = centre_and_scale(cells)
    i, v, noise = F.col("row_idx"), F.col("value"), hashed_noise() if noise is None else noise
    inside = (i >= start) & (i < stop)
    held = cells.where(i == start).select("series_id", "channel", v.alias("held"))
    all_ = cells.join(stats, ["series_id", "channel"]).join(held, ["series_id", "channel"], "left")
    if kind == "correlation_break":
        width = stop - start
        before = start >= width
        near = cells.where(F.when(before, (i >= start - width) & (i < start)).otherwise((i >= stop) & (i < stop + width)))
        shifted = near.select("series_id", "channel", (i + F.when(before, width).otherwise(-width)).alias("row_idx"), v.alias("elsewhere"))
        all_ = all_.join(shifted, ["series_id", "channel", "row_idx"], "left")
    if variant == "stuck":
        all_ = all_.join(selection.quantiles(cells, ("series_id", "channel"), "value", {"extreme": 0.95}), ["series_id", "channel"])
    if variant in ("collapse", "inverted"):
        all_ = all_.join(_medians(cells, inside, "middle"), ["series_id", "channel"], "left")
    if variant == "collapse":
        all_ = all_.join(_medians(cells, (i >= 2 * start - stop) & (i < start), "earlier"), ["series_id", "channel"], "left")
    if variant == "inverted":
        partner = correlated_partner(cells).select("series_id", "channel", "partner")
        theirs = stats.select("series_id", F.col("channel").alias("partner"), F.col("scale").alias("their_scale"))
        theirs = theirs.join(_medians(cells, inside, "their_middle").withColumnRenamed("channel", "partner"), ["series_id", "partner"])
        shown = cells.where(inside).select("series_id", "row_idx", F.col("channel").alias("partner"), v.alias("theirs"))
        shown = shown.join(theirs, ["series_id", "partner"]).join(partner, ["series_id", "partner"]).drop("partner")
        all_ = all_.join(shown, ["series_id", "channel", "row_idx"], "left")
    share = (i - start + 1) / (stop - start)
    ramp = F.when(stop - start > 1, (i - start) / (stop - start - 1)).otherwise(0.0)
    size = strength * F.col("scale")
    other = {
        "subtle": lambda: v + F.least(F.greatest(F.lit(strength), F.lit(0.8)), F.lit(1.8)) * F.col("scale"),
        "noisy": lambda: F.coalesce("held", v) + 0.02 * F.col("scale") * noise,
        "stuck": lambda: F.col("extreme") + 0.03 * F.col("scale") * noise,
        "linear": lambda: v + size * ramp,
        "worn": lambda: v + 0.5 * size * ramp * ramp + 0.4 * size * ramp * noise,
        "ramped": lambda: v + 0.5 * size * (0.2 + 0.8 * ramp) * noise,
        "collapse": lambda: F.coalesce("earlier", "middle") + (v - F.col("middle")) * 0.07,
        "inverted": lambda: F.coalesce(F.col("middle") - (F.col("theirs") - F.col("their_middle")) * F.col("scale") / F.col("their_scale"), v),
    }
    changed = {
        "spike": F.when(i == F.floor((start + stop) / 2), v + size).otherwise(v),
        "level_shift": v + size,
        "flatline": F.coalesce("held", v),
        "drift": v + size * share * share,
        "noise_burst": v + size * F.when((i - start) % 2 == 0, 1).otherwise(-1),
        "pattern_change": F.col("centre") + size * F.sin((i - start) * 0.7853981633974483),
        "correlation_break": F.coalesce(F.col("elsewhere"), v) if kind == "correlation_break" else v,
        "missing_data": F.lit(None).cast("double"),
    }[kind]
    changed = changed if variant is None else other[variant]()
    hit = inside & ((i == F.floor((start + stop) / 2)) if kind == "spike" else F.lit(True))
    made = all_.withColumn("hit", hit).withColumn("new", F.when(hit, changed).otherwise(v))
    moved = F.avg(F.when(F.col("hit"), F.abs(F.col("new") - v) / F.col("scale")))
    effect = made.groupBy("series_id", "channel").agg((F.lit(True) if kind == "missing_data" else F.coalesce(moved >= LEAST_EFFECT, F.lit(False))).alias("effective"))
    out = made.join(effect, ["series_id", "channel"]).withColumn("hit", F.col("hit") & F.col("effective"))
    kept = [c for c in cells.columns if c not in ("value", "label", "type")]
    return out.select(*kept, F.when(F.col("hit"), F.col("new")).otherwise(v).alias("value"), F.when(F.col("hit"), 1).otherwise(0).alias("label"), F.when(F.col("hit"), TYPES.index(kind)).otherwise(0).alias("type"))


def from_template(cells: DataFrame, bank: DataFrame, placed: DataFrame) -> DataFrame:
    """``cells`` with real events put in: ``value, label`` (1 on the event's rows), ``type`` (-1 there: unknown).

    ``bank`` has templates (``events.templates`` with ``length``), ``placed`` a row a series: ``series_id, template,
    template_start`` (a template's key), ``start`` (first row), ``stretch`` (of its time), ``gain``. A template's event and
    what follows it are stretched linearly and added in units of a channel's scale; the i-th channel of a series takes the
    i-th of the template, whose places follow each other from 0. A series stays as it is, labels included, if the template doesn't end before the series
    does or the event meets rows that are labelled already, and so does a channel that the event moves by less than
    ``LEAST_EFFECT`` spreads. Moved cells are written, as the effect is measured on all of a series' before any is moved.
    """
    key = ["template", "template_start"]
    # A template's channel as an array: bounded by the bank's longest event.
    one = F.sort_array(F.collect_list(F.struct("place", "z")))
    channels = bank.where("place >= 0").groupBy(F.col("series_id").alias("template"), F.col("start").alias("template_start"), "channel").agg(one.alias("zs"), F.max("length").alias("own_length"))
    channels = channels.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("channel"))).withColumn("m", F.size("zs"))
    rows = cells.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    plan = placed.join(channels, key).join(rows, "series_id").select(
        "series_id", "rank", F.col("start").alias("begin"), "gain", "m", "zs.z",
        F.greatest(F.lit(2), F.round(F.col("m") * F.col("stretch"))).cast("long").alias("n_new"),
        F.greatest(F.lit(1), F.round(F.col("own_length") * F.col("stretch"))).cast("long").alias("n_event"), "n_rows",
    ).where("begin + n_new < n_rows")
    ranks = centre_and_scale(cells).withColumn("rank", F.dense_rank().over(Window.partitionBy("series_id").orderBy("channel")))  # a row a channel
    every = cells.select("series_id", "row_idx", "channel", *(c for c in cells.columns if c not in ("series_id", "row_idx", "channel", "type")))
    j = F.col("row_idx") - F.col("begin")
    x = j * (F.col("m") - 1) / (F.col("n_new") - 1)
    all_ = every.join(ranks.join(plan, ["series_id", "rank"], "left"), ["series_id", "channel"]).withColumn("x", F.when((j >= 0) & (j < F.col("n_new")), x))
    at = F.floor("x").cast("int")
    all_ = all_.withColumn("part", F.col("x") - at).withColumn("next_z", F.get("z", at + 1)).withColumn("z", F.get("z", at))
    added = (F.col("z") + F.col("part") * (F.coalesce("next_z", "z") - F.col("z"))) * F.col("scale") * F.col("gain")
    moved = F.abs(F.col("new") - F.col("value")) / F.col("scale")
    made = all_.withColumn("new", F.col("value") + added).withColumn("hit", F.col("z").isNotNull() & (j < F.col("n_event")))
    made = written(made.withColumn("moved", F.when(F.col("hit"), moved)).select(*every.columns, "new", "hit", "moved"), "moved")
    made = selection.dealt(made, ("series_id",))
    effect = made.groupBy("series_id", "channel").agg(
        F.coalesce(F.avg("moved") >= LEAST_EFFECT, F.lit(False)).alias("effective"),
        F.max(F.col("hit") & (F.col("label") == 1)).alias("met"),
    )
    busy = effect.groupBy("series_id").agg(F.coalesce(F.max("met"), F.lit(False)).alias("busy"))
    use = effect.join(busy, "series_id").select("series_id", "channel", (F.col("effective") & ~F.col("busy")).alias("used"))
    out = made.join(use, ["series_id", "channel"])
    kept = [c for c in cells.columns if c not in ("value", "label", "type")]
    hit = F.col("used") & F.col("hit")
    return out.select(*kept, F.when(F.col("used"), F.coalesce("new", "value")).otherwise(F.col("value")).alias("value"), F.when(hit, 1).otherwise(F.col("label")).alias("label"), F.when(hit, -1).otherwise(0).alias("type"))
