"""Adapters from raw files to cells and a catalog.

Most sources are wide tables with a time column and a row label; a ``Wide`` describes one. The others build on the
same canonical step. Files are read by Spark's readers only, so any store will do. An adapter takes
``(spark, path)`` and gives ``(cells, catalog)``; it is found by name in ``LOADERS``.

Two passes where the channels depend on the data: one aggregate over the source gives each channel's known share,
deviation and volatility (a row a channel), a list of names goes to the driver, the second pass reads those columns.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import missing, unix_seconds
from ..operators import label_rules, labels, reshape, runs, scans, series
from .files import file_order, row_numbers_in_file

#: Sources whose labels are weak (from a time limit) or predictive, and the benchmark each source is in.
WEAK = ("cmapss", "ims_bearing", "femto")
PREDICTIVE = ("care", "care_c")
BENCHMARK = {"nab": "TSB-AD-U", "smap": "TSB-AD-M", "msl": "TSB-AD-M", "smd": "TSB-AD-M", "skab": "SKAB benchmark", "ucr": "UCR Anomaly Archive", "psm": "TSB-AD-M"}
#: The licences that sources state; ``unclear`` where they state none.
LICENSES = {
    "skab": "AGPL-3.0", "skab_teaser": "AGPL-3.0", "nab": "AGPL-3.0", "smap": "Apache-2.0", "msl": "Apache-2.0", "pump": "unclear", "smd": "MIT", "cnc": "CC0-1.0",
    "wind_gearbox": "Apache-2.0", "hai": "CC-BY-SA-4.0", "metropt": "CC-BY-4.0", "cats": "CC-BY-4.0", "tep": "CC-BY-4.0", "cmapss": "CC0-1.0", "hydraulic": "CC-BY-4.0",
    "telecom_milan": "CC-BY", "bidmc": "ODC-BY-1.0", "mitbih": "ODC-BY-1.0", "batadal": "unclear", "ved": "Apache-2.0", "stocks": "CC0-1.0", "esa": "CC-BY-4.0",
    "bosch_cnc": "CC-BY-4.0", "lbnl": "CC-BY-4.0", "ims_bearing": "public domain", "bgl": "unclear", "binance": "unclear", "ucr": "academic", "psm": "MIT", "damadics": "academic",
    "asd": "MIT", "uci": "CC-BY-4.0", "femto": "academic", "kantine": "Apache-2.0", "lead": "CC-BY-4.0", "w3": "CC-BY-4.0", "esa_full": "CC-BY-4.0", "esa2": "CC-BY-4.0",
    "care": "CC-BY-SA-4.0", "care_c": "CC-BY-SA-4.0", "refit": "CC-BY-4.0", "msft": "MIT", "ctf": "unclear", "kelmarsh": "CC-BY-4.0", "penmanshiel": "CC-BY-4.0",
    "battledim": "CC-BY-4.0", "opssat": "CC-BY-4.0", "alfa": "CC0-1.0", "road": "CC-BY-4.0", "pvfault": "Apache-2.0",
}
#: Start of made-up time axes: 2020-01-01.
EPOCH = 1_577_836_800.0

Loaded = tuple[DataFrame, DataFrame]
LOADERS: dict[str, Callable[[SparkSession, str], Loaded]] = {}


def loader(name: str) -> Callable:
    def add(f: Callable[[SparkSession, str], Loaded]) -> Callable[[SparkSession, str], Loaded]:
        LOADERS[name] = f
        return f

    return add


def file_stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z0-9]+)*$", 1)


def folder_name() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)


def pool_folder(source: str) -> str:
    """Where ``write_pool`` puts a source's cells, within the pool."""
    return f"source={source}"


def canonical(rows: DataFrame, source: str, sector: str, channels: list[str], level: str = "row", synthetic: bool = False, quality: str | None = None, confidence: float | None = None, note: str = "") -> Loaded:
    """``rows`` (``series_id, timestamp, label``, the channels, and ``order`` to break ties) as cells and catalog rows.

    ``label`` is one value a row, or an array with one a channel.
    """
    arrays = dict(rows.dtypes)["label"].startswith("array")
    ordered = reshape.row_numbers(rows, "series_id", "timestamp", "order")
    labels = F.col("label") if arrays else F.array_repeat(F.col("label").cast("int"), len(channels))
    values = F.array(*(missing(F.col(f"`{c}`").cast("double")) for c in channels))
    zipped = F.arrays_zip(values.alias("value"), labels.alias("label"))
    cells = ordered.select("series_id", "row_idx", "timestamp", F.posexplode(zipped).alias("channel", "cell")).select(
        "series_id", "row_idx", "timestamp", "channel", F.col("cell.value").alias("value"), F.col("cell.label").cast("int").alias("label")
    )
    top = F.array_max("label") if arrays else F.col("label")
    step = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("series_id").orderBy("row_idx"))
    each = ordered.select("series_id", top.alias("top"), step.alias("step"))
    q = quality or ("weak" if source in WEAK else "predictive" if source in PREDICTIVE else "source")
    trust = confidence if confidence is not None else {"weak": 0.2, "predictive": 0.3}.get(q, 1.0)
    counted = each.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.median("step").alias("step_s"), F.when(F.max("top") >= 0, F.count_if(F.col("top") == 1) / F.count("*")).alias("anomaly_row_ratio"), (F.max("top") == -1).alias("unlabeled")
    )
    benchmark = BENCHMARK.get(source)
    catalog = counted.select(
        "series_id", F.lit(source).alias("source"), F.lit(sector).alias("sector"), "n_rows", F.lit(len(channels)).alias("n_channels"), "step_s", F.lit(level).alias("label_level"), "anomaly_row_ratio",
        "unlabeled", F.lit(synthetic).alias("synthetic_time"), F.lit(benchmark).cast("string").alias("benchmark"), F.lit(LICENSES.get(source, "")).alias("license"), F.lit("|".join(channels)).alias("channel_names"), F.lit(float(trust)).alias("label_confidence"),
        F.lit(q).alias("label_quality"), F.lit(note).alias("note"), F.lit(pool_folder(source)).alias("file"),
    )
    return cells, catalog


@dataclass
class Wide:
    """A source of wide delimited or Parquet files."""

    sector: str
    time: str | None = None  #: the time column; None: made up from ``step``
    format: str | None = None  #: of the time column, for ``to_timestamp``; ``unix`` and ``ms`` for numbers
    step: float = 1.0
    series: Callable[[], Column] = file_stem
    label: Callable[[], Column] | None = None  #: None: unknown
    drop: tuple[str, ...] = ()  #: columns that are no channels
    keep: str | None = None  #: pattern that a channel's name has to match
    options: dict = field(default_factory=dict)
    parquet: bool = False
    pattern: str = "*"
    sentinel: float | None = None  #: a value that means missing
    known: float = 0.0  #: least share of known values of a channel
    moving: bool = False  #: whether constant channels go
    top: int | None = None  #: this many channels of largest volatility
    least: int = 1  #: least rows of a series
    counted: str | None = None  #: only rows with a value here count towards ``least``
    intervals: tuple[tuple[float, float], ...] = ()  #: closed anomalous times
    onset: int | None = None  #: repair: rows of an event that stay anomalies; also asks for normal rows before events
    test_from: float | None = None  #: rows before this share of a series are unknown
    quality: str | None = None
    confidence: float | None = None


def time_column(spec: Wide) -> Column:
    if spec.time is None:
        return F.lit(None).cast("double")
    t = F.col(f"`{spec.time}`")
    if spec.format == "unix":
        return t.cast("double")
    if spec.format == "ms":
        return t.cast("double") / 1000
    return unix_seconds(F.to_timestamp(t.cast("string"), spec.format) if spec.format else F.to_timestamp(t.cast("string")))


def measured_channels(rows: DataFrame, names: list[str], spec: Wide) -> list[str]:
    """The channels that pass the source's rules; one aggregate row, so a few names and numbers reach the driver."""
    if not (spec.known or spec.moving or spec.top):
        return names
    v = {c: missing(F.col(f"`{c}`").cast("double")) for c in names}
    parts = [x for i, c in enumerate(names) for x in (F.avg(v[c].isNotNull().cast("double")).alias(f"k{i}"), F.stddev_samp(v[c]).alias(f"s{i}"), F.median(F.abs(v[c])).alias(f"m{i}"))]
    got = rows.agg(*parts).head()
    able = [(c, (got[f"s{i}"] or 0.0) / ((got[f"m{i}"] or 0.0) + 1e-9)) for i, c in enumerate(names) if (got[f"k{i}"] or 0) > spec.known and (not spec.moving or (got[f"s{i}"] or 0) > 0)]
    if spec.top is not None and len(able) > spec.top:
        best = {c for c, _ in sorted(able, key=lambda x: (-x[1], x[0]))[: spec.top]}
        able = [x for x in able if x[0] in best]
    return [c for c, _ in able]


def numeric_names(raw: DataFrame, spec: Wide) -> list[str]:
    """The numeric columns that may be channels, by name and type."""
    numeric = [c for c, k in raw.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")]
    return [c for c in numeric if c != spec.time and c not in spec.drop and (spec.keep is None or re.search(spec.keep, c))]


def load_wide(spark: SparkSession, path: str, source: str, spec: Wide) -> Loaded:
    """Any source that a ``Wide`` describes."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", spec.pattern)
    raw = reader.parquet(path) if spec.parquet else reader.options(header=True, inferSchema=True, **spec.options).csv(path)
    columns = [c.strip() for c in raw.columns]
    raw = raw.select("*", file_order().alias("order")).toDF(*columns, "order")
    names = numeric_names(raw, spec)
    label = spec.label() if spec.label else F.lit(-1)
    rows = raw.select(*(F.col(f"`{c}`") for c in names), spec.series().alias("series_id"), time_column(spec).alias("timestamp"), label.cast("int").alias("label"), "order")
    if spec.sentinel is not None:
        rows = rows.select(*(F.nullif(F.col(f"`{c}`").cast("double"), F.lit(spec.sentinel)).alias(c) for c in names), "series_id", "timestamp", "label", "order")
    names = measured_channels(rows, names, spec)
    if spec.time is None:
        rows = reshape.row_numbers(rows, "series_id", "order").withColumn("timestamp", F.lit(EPOCH) + spec.step * F.col("row_idx")).drop("row_idx")
    if spec.least > 1:
        large = rows.groupBy("series_id").agg(F.count(missing(F.col(f"`{spec.counted}`").cast("double")) if spec.counted else "*").alias("n")).where(F.col("n") >= spec.least).select("series_id")
        rows = rows.join(large, "series_id", "left_semi")
    for a, b in spec.intervals:
        rows = rows.withColumn("label", F.when(F.col("timestamp").between(a, b), 1).otherwise(F.greatest("label", F.lit(0))))
    if spec.onset is not None or spec.test_from is not None:
        rows = reshape.row_numbers(rows, "series_id", "timestamp", "order")
        if spec.test_from is not None:
            n = F.count("*").over(Window.partitionBy("series_id"))
            rows = rows.withColumn("label", F.when(F.col("row_idx") < F.floor(n * spec.test_from), -1).otherwise(F.col("label")))
        if spec.onset is not None:
            rows = runs.context_fix(rows, spec.onset)
        rows = rows.drop("row_idx")
    return canonical(rows, source, spec.sector, names, synthetic=spec.time is None, quality=spec.quality, confidence=spec.confidence)


def flag(name: str, *hits: object) -> Callable[[], Column]:
    """Label 1 where a column is one of ``hits`` (or positive, if none are given); null is 0."""
    c = F.col if hits else (lambda n: F.col(n).cast("double"))
    return lambda: F.coalesce((c(f"`{name}`").isin(*hits) if hits else c(f"`{name}`") > 0).cast("int"), F.lit(0))


#: Rows of an event that stay anomalies, event classes that come too slowly for any to stay.
ONSET = 2048
SLOW_CLASSES = ("7", "8")


def well_label() -> Column:
    """Wells: positive classes are anomalies, unknown in folders of slow classes; no class is unknown."""
    kind = F.nanvl(F.col("class").cast("double"), F.lit(None).cast("double"))
    return F.when(kind.isNull(), -1).when(kind <= 0, 0).when(folder_name().isin(*SLOW_CLASSES), -1).otherwise(1)


#: The sources that are wide tables. Column names and rules are those of the raw files.
WIDE: dict[str, Wide] = {
    "skab": Wide("manufacturing", "datetime", label=flag("anomaly"), drop=("anomaly", "changepoint"), options={"sep": ";"}, series=lambda: F.concat_ws("/", folder_name(), file_stem())),
    "pump": Wide("manufacturing", "timestamp", label=flag("machine_status", "BROKEN", "RECOVERING"), drop=("_c0",), known=1e-9),
    "cnc": Wide("manufacturing", step=0.1, pattern="experiment_*.csv", moving=True),
    "wind_gearbox": Wide("energy", step=600.0, label=flag("label"), drop=("label",)),
    "metropt": Wide("transport", "timestamp", drop=("_c0",), intervals=((1587168000.0, 1587254340.0), (1590795000.0, 1590818400.0), (1591354800.0, 1591549200.0), (1594823400.0, 1594838700.0))),
    "batadal": Wide("water", "DATETIME", "d/M/yy H", label=flag("ATT_FLAG"), drop=("ATT_FLAG",)),
    "ved": Wide("automotive", "Timestamp(ms)", "ms", series=lambda: F.concat_ws("/", F.col("VehId"), F.col("Trip")), drop=("VehId", "Trip", "DayNum"), least=200, known=1e-9),
    "stocks": Wide("finance", "Date", drop=("OpenInt",), pattern="*.txt", least=1000),
    "lbnl": Wide("buildings", "Datetime", label=flag("Fault Detection Ground Truth"), drop=("Fault Detection Ground Truth",), options={"nullValue": "NA"}, onset=2048),
    "binance": Wide("finance", "open_time", parquet=True),
    "damadics": Wide("chemical", step=1.0, moving=True, options={"sep": "\t"}),
    "msft": Wide("it", "datetime", series=lambda: F.col("machineID").cast("string"), label=flag("label"), drop=("machineID", "label"), least=100),
    "lead": Wide("building", "timestamp", series=lambda: F.col("building_id").cast("string"), label=flag("anomaly"), drop=("building_id", "anomaly"), least=500, counted="meter_reading"),
    "opssat": Wide("space", "timestamp", series=lambda: F.col("channel"), label=flag("anomaly"), drop=("anomaly", "segment", "train"), least=300),
    "w3": Wide("oil_gas", "timestamp", parquet=True, pattern="WELL-*.parquet", series=lambda: F.concat_ws("/", folder_name(), file_stem()), label=lambda: well_label(), drop=("class", "state"), known=0.5, moving=True, least=200, onset=ONSET),
}
for _name, _spec in WIDE.items():
    LOADERS[_name] = lambda spark, path, n=_name, s=_spec: load_wide(spark, path, n, s)


def labelled_rows(rows: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """``rows`` with the labels of closed time ``intervals`` (``series_id, a, b, label``)."""
    return reshape.interval_label(rows.drop("label"), intervals, "timestamp", width)


def united(parts: list[Loaded], path: str) -> Loaded:
    """Parts of one source with channels of their own, as one source."""
    if not parts:
        raise ValueError(f"no files of this source in {path}")
    return reduce(DataFrame.unionByName, (p[0] for p in parts)), reduce(DataFrame.unionByName, (p[1] for p in parts))


def file_names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths of a few files by name; only the listing is read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return sorted(r["path"] for r in found.select("path").collect())


def load_farms(source: str, farms: tuple[str, ...]) -> Callable[[SparkSession, str], Loaded]:
    """Folders ``Wind Farm X`` with ``event_info.csv`` and a file an event in ``datasets``.

    Rows of an anomaly's window (by row id) are anomalous, others normal while the turbine produces or stands by (status
    0 and 2), else unknown. Farms that aren't there are left out; each farm has its own channels.
    """
    spec = Wide("energy", "time_stamp", drop=("status_type_id", "id", "asset_id"), keep="_avg$", known=0.5, moving=True, top=100)

    def farm(spark: SparkSession, path: str, name: str) -> Loaded:
        read = spark.read.options(header=True, inferSchema=True, sep=";")
        raw = read.csv(f"{path}/Wind Farm {name}/datasets", pathGlobFilter="*.csv")
        names = measured_channels(raw, numeric_names(raw, spec), spec)
        info = read.csv(f"{path}/Wind Farm {name}/event_info.csv").where("event_label = 'anomaly'")
        windows = info.groupBy(F.col("event_id").cast("long").alias("event")).agg(F.max(F.struct("event_start_id", "event_end_id")).alias("w"))
        rows = raw.select(file_stem().cast("long").alias("event"), time_column(spec).alias("timestamp"), F.col("id").alias("order"), F.col("status_type_id").alias("status"), *(F.col(f"`{c}`") for c in names))
        inside = F.col("order").between(F.col("w.event_start_id"), F.col("w.event_end_id"))
        label = F.when(inside, 1).when(F.col("status").isin(0, 2), 0).otherwise(-1)
        rows = rows.join(windows, "event", "left").withColumn("label", label).withColumn("series_id", F.concat(F.lit(f"farm{name}/event"), F.col("event"))).drop("w", "event", "status")
        return canonical(rows, source, spec.sector, names)

    def load(spark: SparkSession, path: str) -> Loaded:
        there = {p.split("/")[-2] for p in file_names(spark, path, "event_info.csv")}  # at most a few farms
        return united([farm(spark, path, n) for n in farms if f"Wind Farm {n}" in there], path)

    return load


LOADERS["care"], LOADERS["care_c"] = load_farms("care", ("A", "B")), load_farms("care_c", ("C",))

#: Parts of names of derived columns, which give the turbine's state away, and of summaries and counters.
DERIVED = (
    "Lost Production", "Energy", "Potential", "Budget", "Theoretical", "Virtual", "Compensated", "Available Capacity",
    "setpoint", "counter", "Long Term", "Cascading", "Manufacturer", "Production", "Standard deviation", "StdDev",
    ", Min", ", Max", ", Std", "Minimum", "Maximum", "Time-based", "Contractual", "Curtailment", "Count", "Hours", "Status",
    "Performance Ratio", "Capacity factor", "calibration point",
)


def load_turbines(source: str) -> Callable[[SparkSession, str], Loaded]:
    """Unpacked files ``Turbine_Data_<farm>_<turbine>_<year>…`` with a ``Status_…`` log each; a series a turbine and year.

    Lines before the header start with ``#``, the header of the values does as well; all files of a call have the same
    one. Forced outages and faults mark an anomaly's first rows, other stops and lost communication unknown rows. Files
    without a log and series of fewer than 1,000 rows are left out.
    """
    spec = Wide("energy", "ts", keep="(?i)^(?!.*(" + "|".join(map(re.escape, DERIVED)) + "))", known=0.5, moving=True, top=40)
    everywhere = {"recursiveFileLookup": True}
    name = lambda kind: F.format_string("wt%02d/%s", F.regexp_extract(file_stem(), rf"^{kind}_[^_]+_(\d+)_(\d{{4}})", 1).cast("int"), F.regexp_extract(file_stem(), rf"^{kind}_[^_]+_(\d+)_(\d{{4}})", 2))

    def load(spark: SparkSession, path: str) -> Loaded:
        lines = spark.read.options(**everywhere, pathGlobFilter="Turbine_Data_*.csv").text(path)
        heads = lines.where(F.col("value").startswith("# Date and time")).select("value").distinct().limit(2).collect()
        if len(heads) != 1:
            raise ValueError(f"the files in {path} have {'several headers; load them by header' if heads else 'no header'}")
        columns = ["ts", *next(csv.reader([heads[0]["value"]]))[1:]]
        raw = spark.read.options(**everywhere, comment="#", inferSchema=True, pathGlobFilter="Turbine_Data_*.csv").csv(path)
        raw = raw.select("*", file_order().alias("order")).toDF(*columns, "order")
        names = measured_channels(raw, numeric_names(raw, spec), spec)
        rows = raw.select(name("Turbine_Data").alias("series_id"), time_column(spec).alias("timestamp"), "order", *(F.col(f"`{c}`") for c in names)).where("timestamp is not null")
        logged = spark.read.options(**everywhere, pathGlobFilter="Status_*.csv").text(path).select(name("Status").alias("series_id")).distinct()
        large = rows.groupBy("series_id").count().where("count >= 1000").join(logged, "series_id", "left_semi").select("series_id")
        rows = rows.join(large, "series_id", "left_semi")
        log = spark.read.options(**everywhere, comment="#", header=True, pathGlobFilter="Status_*.csv").csv(path)
        at = lambda c: unix_seconds(F.try_to_timestamp(F.col(f"`{c}`")))
        # The row strictly before a start counts, so starts are moved back by less than any step.
        log = log.select(name("Status").alias("series_id"), (at("Timestamp start") - 0.001).alias("start"), at("Timestamp end").alias("stop"), "Status", F.col("IEC category").alias("category"), F.col("Service contract category").alias("service")).where("start is not null")
        stop = F.col("Status") == "Stop"
        fault = stop & (F.coalesce(F.col("category") == "Forced outage", F.lit(False)) | F.coalesce(F.col("service").rlike("error|Safety chain"), F.lit(False)))
        marked = label_rules.status_labels(rows, log, fault, F.col("Status").isin("Stop", "Communication"))
        first = runs.onset_cut(reshape.row_numbers(marked, "series_id", "timestamp", "order"), ONSET).drop("row_idx")
        return canonical(first, source, spec.sector, names, quality="log", confidence=0.5)

    return load


LOADERS["kelmarsh"], LOADERS["penmanshiel"] = load_turbines("kelmarsh"), load_turbines("penmanshiel")


@loader("battledim")
def load_network(spark: SparkSession, path: str) -> Loaded:
    """Files ``<year>_SCADA_Pressures.csv``, ``…_Flows``, ``…_Levels`` and ``<year>_Leakages.csv`` with decimal commas; a
    series a year, its measured files joined by time, labelled by the onsets of leaks."""
    def table(year: str, kind: str) -> DataFrame:
        raw = spark.read.options(header=True, sep=";").csv(f"{path}/{year}_{kind}.csv")
        number = lambda c: F.regexp_replace(F.col(f"`{c}`"), ",", ".").cast("double").alias(c)
        return raw.select(unix_seconds(F.to_timestamp(F.col(f"`{raw.columns[0]}`"))).alias("timestamp"), *map(number, raw.columns[1:]))

    def one_year(year: str) -> Loaded:
        parts = [table(year, f"SCADA_{k}") for k in ("Pressures", "Flows", "Levels")]
        names = [c for t in parts for c in t.columns[1:]]
        wide = reduce(lambda a, b: a.join(b, "timestamp", "full"), parts).withColumns({"series_id": F.lit(year), "order": F.lit(0)})
        rows = reshape.row_numbers(wide, "series_id", "timestamp")
        leaks = table(year, "Leakages")
        by_row = rows.select("row_idx", "timestamp").join(leaks, "timestamp", "left").fillna(0.0, leaks.columns[1:])
        flows = by_row.unpivot("row_idx", leaks.columns[1:], "leak", "flow")
        labelled = rows.join(label_rules.leak_labels(flows), "row_idx").drop("row_idx")
        return canonical(labelled, "battledim", "water", names, quality="onset", confidence=0.5)

    files = file_names(spark, path, "*_SCADA_Pressures.csv")  # one a year
    return united([one_year(p.split("/")[-1].split("_")[0]) for p in files], path)


@loader("uci")
def load_rooms(spark: SparkSession, path: str) -> Loaded:
    """Hourly air (decimal commas, -200 for missing), ten-minute energy use and the occupancy of a room; no labels. Files
    that aren't there are left out."""
    at = lambda c, f=None: unix_seconds(F.try_to_timestamp(c, *([F.lit(f)] if f else []))).alias("timestamp")
    as_rows = lambda raw, name, time, values: raw.select(F.lit(name).alias("series_id"), time, F.lit(-1).alias("label"), file_order().alias("order"), *values)
    parts = []
    for file in file_names(spark, path, "*.{csv,txt}"):  # five files
        stem = file.split("/")[-1].split(".")[0]
        if stem == "AirQualityUCI":
            raw = spark.read.options(header=True, sep=";").csv(file).where("Date is not null")
            names = [c for c in raw.columns if c not in ("Date", "Time") and not re.fullmatch(r"_c\d+", c)]
            number = lambda c: F.nullif(F.regexp_replace(F.col(f"`{c}`"), ",", ".").cast("double"), F.lit(-200.0)).alias(c)
            rows = as_rows(raw, "air_quality", at(F.concat_ws(" ", "Date", "Time"), "dd/MM/yyyy HH.mm.ss"), map(number, names))
            parts.append(canonical(rows, "uci", "environment", names))
        elif stem == "energydata_complete":
            raw = spark.read.options(header=True).csv(file)
            names = [c for c in raw.columns if c != "date"]
            rows = as_rows(raw, "appliances", at(F.col("date")), (F.col(f"`{c}`").cast("double").alias(c) for c in names))
            parts.append(canonical(rows, "uci", "building", names))
        elif stem in ("datatraining", "datatest", "datatest2"):
            names = ["Temperature", "Humidity", "Light", "CO2", "HumidityRatio"]
            # Rows have a number before the columns that the header names.
            kinds = ", ".join(f"{c} string" for c in ("number", "date", *names, "occupied"))
            raw = spark.read.schema(kinds).csv(file).where("number != 'date'")
            rows = as_rows(raw, f"occupancy_{stem}", at(F.col("date")), (F.col(c).cast("double").alias(c) for c in names))
            parts.append(canonical(rows, "uci", "building", names))
    return united(parts, path)


@loader("refit")
def load_houses(spark: SparkSession, path: str, width: int = 60, days: int = 60, least: int = 1000) -> Loaded:
    """A file a house of power readings some seconds apart: means of minutes, minutes without readings missing, in series
    of ``days`` from the house's first minute; series of fewer than ``least`` complete rows are left out. No labels."""
    raw = spark.read.options(header=True, inferSchema=True, pathGlobFilter="House_*.csv").csv(path)
    spec = Wide("residential", "Unix", "unix", known=0.5, moving=True)
    names = numeric_names(raw, spec)
    minute = (F.floor(F.col("Unix") / width) * width).cast("long").alias("minute")
    means = raw.groupBy(F.lower(file_stem()).alias("house"), minute).agg(*(F.avg(missing(F.col(f"`{c}`").cast("double"))).alias(c) for c in names))
    spans = means.groupBy("house").agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    spaced = spans.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / (days * 86400)))))
    start = F.col("first") + F.col("part") * days * 86400
    grid = spaced.select("house", "part", F.explode(F.sequence(start, F.least(start + days * 86400 - width, F.col("last")), F.lit(width).cast("long"))).alias("minute"))
    filled = grid.join(means, ["house", "minute"], "left")
    names = measured_channels(filled, names, spec)
    rows = filled.select(F.format_string("%s/p%02d", "house", "part").alias("series_id"), F.col("minute").cast("double").alias("timestamp"), F.lit(-1).alias("label"), F.lit(0).alias("order"), *(F.col(f"`{c}`") for c in names))
    whole = reduce(Column.__and__, (F.col(f"`{c}`").isNotNull() for c in names), F.lit(bool(names)))
    large = rows.where(whole).groupBy("series_id").count().where(F.col("count") >= least).select("series_id")
    return canonical(rows.join(large, "series_id", "left_semi"), "refit", spec.sector, names)


@loader("hai")
def load_attacks(spark: SparkSession, path: str) -> Loaded:
    """Files by version, each with channels and a separator of its own: training ones are normal, test ones have attacks in
    columns or in a file ``label-…``. Attacks on a process count for its channels, those on no known process for all; test
    files without either are unknown."""
    files = file_names(spark, path, "*.csv")  # some dozens

    def one(file: str) -> Loaded:
        folder, name = file.split("/")[-2:]
        head = spark.read.text(file).head()
        raw = spark.read.options(header=True, inferSchema=True, sep=";" if head and ";" in head[0] else ",").csv(file)
        raw = raw.toDF(*(c.strip() for c in raw.columns))
        time, marks = raw.columns[0], [c for c in raw.columns if c.lower().startswith("attack")]
        spec = Wide("process_control", time, drop=tuple(marks), moving=True)
        names = measured_channels(raw, numeric_names(raw, spec), spec)
        hit = {c: F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)) == 1 for c in marks}
        by_process = {c[-2:]: hit[c] for c in marks if "_P" in c}
        if "train" in name:
            label = F.lit(0)
        elif by_process:
            anywhere = reduce(Column.__or__, by_process.values())
            label = F.array(*((by_process.get(c[:2] if c[2:3] == "_" else "", F.lit(False)) | (hit[marks[0]] & ~anywhere)).cast("int") for c in names))
        else:
            label = hit[marks[0]].cast("int") if marks else F.lit(-1)
        rows = raw.select(F.lit(f"{folder}/{name.rsplit('.', 1)[0].replace('hai-', '')}").alias("series_id"), time_column(spec).alias("timestamp"), label.alias("label"), file_order().alias("order"), *(F.col(f"`{c}`") for c in names))
        beside = file[: -len(name)] + name.replace("hai-", "label-")
        if not marks and "test" in name and beside in files:
            given = spark.read.options(header=True, inferSchema=True).csv(beside)
            given = given.groupBy(time_column(Wide("", "timestamp")).alias("timestamp")).agg(F.max(F.col("label").cast("int")).alias("given"))
            rows = rows.join(given, "timestamp", "left").withColumn("label", F.coalesce("given", F.lit(0))).drop("given")
        return canonical(rows, "hai", spec.sector, names, level="cell" if by_process and "train" not in name else "row")

    return united([one(f) for f in files if not f.split("/")[-1].startswith("label-")], path)


@loader("skab_teaser")
def load_long(spark: SparkSession, path: str) -> Loaded:
    """Long rows of time, name and value; the mean of repeats."""
    raw = spark.read.options(header=True, inferSchema=True, sep=";").csv(path)
    names = [str(r[0]) for r in raw.select("id").distinct().orderBy("id").collect()]  # a few channel names
    wide = raw.groupBy(unix_seconds(F.to_timestamp(F.col("datetime").cast("string"))).alias("timestamp")).pivot("id", names).agg(F.avg("value"))
    return canonical(wide.select("*", F.lit("0").alias("series_id"), F.lit(-1).alias("label"), F.lit(0).alias("order")), "skab_teaser", "manufacturing", names)


@loader("nab")
def load_windows(spark: SparkSession, path: str) -> Loaded:
    """One-channel files and a JSON of labelled windows by file."""
    raw = spark.read.options(header=True, inferSchema=True, recursiveFileLookup=True, pathGlobFilter="*.csv").csv(path)
    rows = raw.select(F.concat_ws("/", folder_name(), file_stem()).alias("series_id"), unix_seconds(F.to_timestamp(F.col("timestamp").cast("string"))).alias("timestamp"), "value", file_order().alias("order"))
    text = spark.read.option("wholetext", "true").text(f"{path}/combined_windows.json")
    windows = text.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("file", "spans")).select(F.regexp_replace("file", r"\.csv$", "").alias("series_id"), F.explode("spans").alias("s"))
    at = lambda i: unix_seconds(F.to_timestamp(F.element_at("s", i)))
    intervals = windows.select("series_id", at(1).alias("a"), at(2).alias("b"), F.lit(1).alias("label"))
    return canonical(labelled_rows(rows, intervals, 86400.0), "nab", "mixed", ["value"])


@loader("ucr")
def load_named_interval(spark: SparkSession, path: str) -> Loaded:
    """One value a line; train end and the anomaly's first and last row in the file's name."""
    raw = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.txt").where("trim(value) != ''").select(file_stem().alias("series_id"), F.col("value").cast("double").alias("value"), file_order().alias("order"))
    rows = row_numbers_in_file(raw)
    part = lambda i: F.regexp_extract("series_id", r"_(\d+)_(\d+)_(\d+)$", i).cast("long")
    label = F.when(F.col("row_idx") < part(1), -1).when(F.col("row_idx").between(part(2), part(3)), 1).otherwise(0)
    return canonical(rows.select("series_id", "value", "order", label.alias("label"), (F.lit(EPOCH) + F.col("row_idx")).alias("timestamp")), "ucr", "mixed", ["value"], synthetic=True)


@loader("smd")
def load_interpretation(spark: SparkSession, path: str) -> Loaded:
    """Test values, a row label file, and lines ``a-b:c1,c2`` with the channels (from 1) of each anomaly.

    Anomalous rows that no line covers count for all channels; normal rows for none.
    """
    def numbered(folder: str) -> DataFrame:
        text = spark.read.text(f"{path}/{folder}").where("trim(value) != ''").select(file_stem().alias("series_id"), "value", file_order().alias("order"))
        return row_numbers_in_file(text).drop("order")

    values = numbered("test").select("series_id", "row_idx", F.split("value", ",").cast("array<double>").alias("v"))
    k = values.agg(F.max(F.size("v"))).head()[0]
    marks = numbered("test_label").select("series_id", "row_idx", F.col("value").cast("double").cast("int").alias("y"))
    lines = spark.read.text(f"{path}/interpretation_label").select(file_stem().alias("series_id"), F.regexp_extract("value", r"^(\d+)-(\d+):(.*)$", 1).cast("long").alias("a"), F.regexp_extract("value", r"^(\d+)-(\d+):(.*)$", 2).cast("long").alias("b"), F.split(F.regexp_extract("value", r":(.*)$", 1), ",").cast("array<int>").alias("c"))
    spread = lines.select("series_id", F.explode(F.sequence("a", "b")).alias("row_idx"), F.explode_outer("c").alias("c"))
    cover = spread.groupBy("series_id", "row_idx").agg(F.collect_set("c").alias("cs"))  # bounded by the channels
    rows = values.join(marks, ["series_id", "row_idx"]).join(cover, ["series_id", "row_idx"], "left")
    cell = lambda c: F.when(F.col("y") == 0, 0).when(F.col("cs").isNull(), 1).otherwise(F.array_contains("cs", c + 1).cast("int"))
    wide = rows.select("series_id", *(F.col("v")[c].alias(f"ch_{c}") for c in range(k)), F.array(*(cell(c) for c in range(k))).alias("label"), (F.lit(EPOCH) + 60 * F.col("row_idx")).alias("timestamp"), F.col("row_idx").alias("order"))
    return canonical(wide, "smd", "it", [f"ch_{c}" for c in range(k)], level="cell", synthetic=True)


@loader("cmapss")
def load_run_to_failure(spark: SparkSession, path: str) -> Loaded:
    """Blank-separated rows of unit, cycle, settings and sensors; a unit's last 25 rows are weakly anomalous."""
    parts = F.split(F.trim("value"), r"\s+").cast("array<double>")
    raw = spark.read.text(path).where("trim(value) != ''").select(file_stem().alias("f"), parts.alias("v"))
    k = raw.agg(F.max(F.size("v"))).head()[0]
    names = [f"s{i}" for i in range(2, k)]
    rows = raw.select(F.concat_ws("/", "f", F.col("v")[0].cast("int")).alias("series_id"), F.col("v")[1].alias("cycle"), *(F.col("v")[i].alias(f"s{i}") for i in range(2, k)))
    left = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("cycle")))
    rows = rows.withColumn("label", (left <= 25).cast("int")).withColumn("timestamp", F.lit(EPOCH) + F.col("cycle") * 3600).withColumn("order", F.col("cycle"))
    return canonical(rows, "cmapss", "aviation", measured_channels(rows, names, Wide("", moving=True)), synthetic=True)


@loader("bgl")
def load_log(spark: SparkSession, path: str) -> Loaded:
    """Log lines as counts of 60 s bins: all, and by component; a bin with an alert is anomalous, empty bins are 0."""
    word = F.split("value", " ", 10)
    lines = spark.read.text(path).select((F.get(word, F.lit(0)) != "-").alias("alert"), F.get(word, F.lit(1)).try_cast("double").alias("t"), F.get(word, F.lit(7)).alias("part")).where("t is not null")
    bins = lines.groupBy(F.lit("0").alias("series_id"), reshape.binned("t", 60.0).alias("bin")).agg(
        F.count("*").cast("double").alias("total"), *(F.count_if(F.col("part") == p).cast("double").alias(n) for p, n in (("KERNEL", "kernel"), ("APP", "app"), ("HARDWARE", "hardware"))), F.max(F.col("alert").cast("int")).alias("label")
    )
    full = reshape.grid(bins, 60.0, ("series_id",)).join(bins, ["series_id", "bin"], "left").na.fill(0)
    return canonical(full.withColumn("timestamp", F.col("bin")).withColumn("order", F.lit(0)), "loghub", "it", ["total", "kernel", "app", "hardware"])


LOADERS["loghub"] = LOADERS["bgl"]


def load_snapshots(source: str, sector: str, share: float = 0.08) -> Callable[[SparkSession, str], Loaded]:
    """Files of raw vibration, one a snapshot: root mean square, peak and kurtosis of each axis; the last ones are anomalous."""

    def load(spark: SparkSession, path: str) -> Loaded:
        text = spark.read.text(path, recursiveFileLookup=True).select(folder_name().alias("series_id"), file_stem().alias("snap"), F.split(F.trim("value"), r"[\s,;]+").cast("array<double>").alias("v"))
        axis = text.select("series_id", "snap", F.posexplode("v").alias("channel", "value"))
        k = axis.agg(F.max("channel")).head()[0] + 1
        stats = series.snapshot(axis, ("series_id", "snap", "channel"))
        names = [f"{m}_{c}" for c in range(k) for m in ("rms", "peak", "kurtosis")]
        wide = stats.groupBy("series_id", "snap").pivot("channel", list(range(k))).agg(F.first("rms").alias("rms"), F.first("peak").alias("peak"), F.first("kurtosis").alias("kurtosis"))
        wide = wide.select("series_id", "snap", *(F.col(f"{c}_{m}").alias(f"{m}_{c}") for c in range(k) for m in ("rms", "peak", "kurtosis")))
        rows = reshape.row_numbers(wide, "series_id", "snap")
        n = F.count("*").over(Window.partitionBy("series_id"))
        rows = rows.withColumn("label", (F.col("row_idx") >= F.floor(n * (1 - share))).cast("int")).withColumn("timestamp", F.lit(EPOCH) + 600 * F.col("row_idx")).withColumn("order", F.lit(0)).drop("row_idx")
        return canonical(rows, source, sector, names, synthetic=True)

    return load


LOADERS["ims_bearing"] = load_snapshots("ims_bearing", "manufacturing")
LOADERS["femto"] = load_snapshots("femto", "manufacturing")


@loader("hydraulic")
def load_cycles(spark: SparkSession, path: str) -> Loaded:
    """One file a sensor, one line a 60 s cycle of samples at the sensor's rate: means of each second, joined by second."""
    lines = spark.read.text(path, pathGlobFilter="*.txt").where("trim(value) != ''").select(file_stem().alias("sensor"), file_order().alias("order"), F.split(F.trim("value"), r"\s+").cast("array<double>").alias("v"))
    cycle = row_numbers_in_file(lines)
    second = cycle.select("sensor", F.col("row_idx").alias("cycle"), (F.size("v") / 60).cast("int").alias("rate"), F.posexplode("v").alias("i", "x"))
    mean = second.groupBy("sensor", (F.col("cycle") * 60 + F.floor(F.col("i") / F.col("rate"))).alias("row")).agg(F.avg("x").alias("x"))
    names = [r[0] for r in lines.select("sensor").distinct().orderBy("sensor").collect()]  # a few sensor names
    wide = mean.groupBy("row").pivot("sensor", names).agg(F.first("x"))
    return canonical(wide.select("*", F.lit("0").alias("series_id"), (F.lit(EPOCH) + F.col("row")).alias("timestamp"), F.lit(-1).alias("label"), F.col("row").alias("order")), "hydraulic", "industry", names, synthetic=True)


@loader("telecom_milan")
def load_top_cells(spark: SparkSession, path: str, most: int = 400) -> Loaded:
    """Daily files added up by cell and time, null where all parts are; the ``most`` cells with the most known values."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    names = [c for c in raw.columns if c not in ("datetime", "CellID", "countrycode")]
    sums = raw.groupBy(F.col("CellID").cast("string").alias("series_id"), unix_seconds(F.to_timestamp(F.col("datetime").cast("string"))).alias("timestamp")).agg(*(F.sum(c).alias(c) for c in names))
    best = sums.groupBy("series_id").agg(F.count(names[-1]).alias("n")).orderBy(F.desc("n"), "series_id").limit(most).select("series_id")
    return canonical(sums.join(best, "series_id", "left_semi").withColumn("label", F.lit(-1)).withColumn("order", F.lit(0)), "telecom_milan", "telecom", names)


@loader("mitbih")
def load_beats(spark: SparkSession, path: str, reach: int = 54) -> Loaded:
    """Samples, and beats with a symbol; the rows around a beat that isn't normal are anomalous."""
    normal = ["N", "L", "R", "e", "j"]
    samples = spark.read.options(header=True, inferSchema=True, pathGlobFilter="*_signal.csv").csv(path)
    names = [c for c in samples.columns if c != "sample"]
    rows = samples.select(F.regexp_replace(file_stem(), "_signal$", "").alias("series_id"), *names, F.col("sample").cast("double").alias("at"))
    beats = spark.read.options(header=True, inferSchema=True, pathGlobFilter="*_beats.csv").csv(path).select(F.regexp_replace(file_stem(), "_beats$", "").alias("series_id"), "sample", "symbol")
    odd = beats.where(~F.col("symbol").isin(normal)).select("series_id", (F.col("sample") - reach).cast("double").alias("a"), (F.col("sample") + reach - 1).cast("double").alias("b"), F.lit(1).alias("label"))
    marked = reshape.interval_label(rows, odd, "at", 1000.0)
    return canonical(marked.withColumn("timestamp", F.lit(EPOCH) + F.col("at") / 360).withColumn("order", F.col("at")), "mitbih", "health", names, synthetic=True)


@loader("alfa")
def load_topics(spark: SparkSession, path: str, rate: float = 10.0) -> Loaded:
    """Topics at rates of their own (``flight, topic, t, value``) on one grid by the last value before each step;
    rows from a flight's first failure on are anomalous, flights without a failure record unknown."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    names = [r[0] for r in raw.where("topic != 'failure'").select("topic").distinct().orderBy("topic").collect()]  # a few topics
    keyed = raw.select(F.col("flight").cast("string").alias("series_id"), "topic", F.col("t").cast("double").alias("timestamp"), F.col("value").cast("double").alias("value"))
    bounds = keyed.where("topic != 'failure'").select("series_id", reshape.binned("timestamp", 1 / rate).alias("bin"))
    rows = reshape.grid(bounds, 1 / rate, ("series_id",)).withColumnRenamed("bin", "timestamp")
    for name in names:
        right = keyed.where(F.col("topic") == name).select("series_id", "timestamp", F.col("value").alias(name))
        rows = reshape.asof_align(rows, right, "series_id", "timestamp", [name])
    failures = keyed.where("topic = 'failure'").groupBy("series_id").agg(F.min(F.when(F.col("value") > 0, F.col("timestamp"))).alias("from"))
    label = F.when(F.col("known").isNull(), -1).when(F.col("timestamp") >= F.col("from"), 1).otherwise(0)
    rows = rows.join(failures.withColumn("known", F.lit(1)), "series_id", "left").withColumn("label", label).withColumn("order", F.lit(0)).drop("from", "known")
    rows = runs.context_fix(reshape.row_numbers(rows, "series_id", "timestamp"), 2048).drop("row_idx")
    return canonical(rows, "alfa", "aviation", names)


@loader("road")
def load_messages(spark: SparkSession, path: str, width: float = 0.1, most: int = 40) -> Loaded:
    """Bus messages (``t, id, label`` and signals): the last value of each signal in each bin, carried forward over empty
    bins; a bin is anomalous if any message in it is. The ``most`` signals of largest volatility."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    signals = [c for c in raw.columns if c not in ("t", "id", "label")]
    long = raw.select(file_stem().alias("series_id"), F.col("t").cast("double").alias("timestamp"), F.col("label").cast("int").alias("label"), F.col("id").cast("string").alias("id"), F.posexplode(F.array(*(F.col(s).cast("double") for s in signals))).alias("s", "value"))
    named = long.where("value is not null").withColumn("channel", F.concat_ws("_", "id", F.element_at(F.array(*map(F.lit, signals)), F.col("s") + 1))).withColumn("bin", reshape.binned("timestamp", width))
    ranked = series.volatility(named, ("channel",)).orderBy(F.desc("volatility"), "channel").limit(most)
    names = sorted(r["channel"] for r in ranked.collect())  # at most `most` names
    last = reshape.melt_pivot_last(named.where(F.col("channel").isin(names)), ["series_id"], "bin", "channel", names, "value", F.struct("timestamp"))
    marks = named.groupBy("series_id", "bin").agg(F.max("label").alias("label"))
    full = reshape.grid(marks, width, ("series_id",)).withColumn("key", F.round(F.col("bin") / width).cast("long"))
    at = lambda df: df.withColumn("key", F.round(F.col("bin") / width).cast("long")).drop("bin")
    rows = full.join(at(marks), ["series_id", "key"], "left").join(at(last), ["series_id", "key"], "left")
    w = Window.partitionBy("series_id").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select("series_id", F.col("bin").alias("timestamp"), F.coalesce("label", F.lit(0)).alias("label"), F.lit(0).alias("order"), *(F.last(f"`{n}`", ignorenulls=True).over(w).alias(n) for n in names))
    return canonical(filled, "road", "automotive", names)

@loader("tep")
def load_simulations(spark: SparkSession, path: str, runs_: int = 25) -> Loaded:
    """Simulation runs by fault: the first ``runs_`` of each by hash; anomalous after the 20th sample of a fault, of which the
    first 100 rows count; all of it unknown for the faults that can't be seen."""
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    names = [c for c in raw.columns if c.startswith(("xmeas", "xmv"))]
    some = raw.select("faultNumber", "simulationRun").distinct().withColumn("place", F.row_number().over(Window.partitionBy("faultNumber").orderBy(F.xxhash64("simulationRun"), "simulationRun"))).where(F.col("place") <= runs_).drop("place")
    rows = raw.join(some, ["faultNumber", "simulationRun"], "left_semi").withColumn("series_id", F.concat_ws("/", F.col("faultNumber").cast("int"), F.col("simulationRun").cast("int")))
    rows = rows.withColumn("label", ((F.col("faultNumber") > 0) & (F.col("sample") > 20)).cast("int")).withColumn("row_idx", F.col("sample"))
    rows = label_rules.first_positives(rows, 100, F.col("faultNumber").isin(3, 9, 15))
    return canonical(rows.withColumn("timestamp", F.lit(EPOCH) + 180 * F.col("sample")).withColumn("order", F.col("sample")).drop("row_idx"), "tep", "chemical", names, synthetic=True)


@loader("kantine")
def load_episodes(spark: SparkSession, path: str) -> Loaded:
    """Robot episodes with array columns of states and actions; the episodes from the fifth on are anomalous."""
    raw = spark.read.parquet(path)
    arrays = ["observation.state", "action"]
    sizes = raw.agg(*(F.max(F.size(F.col(f"`{a}`"))).alias(f"n{i}") for i, a in enumerate(arrays))).head()
    cols = [(f"{a.split('.')[-1]}_{j}", F.get(F.col(f"`{a}`"), F.lit(j))) for i, a in enumerate(arrays) for j in range(sizes[f"n{i}"])]
    rows = raw.select(F.col("episode_index").cast("string").alias("series_id"), F.col("timestamp").cast("double").alias("timestamp"), F.col("frame_index").alias("order"), (F.col("episode_index") >= 5).cast("int").alias("label"), *(c.alias(n) for n, c in cols))
    fixed = runs.context_fix(reshape.row_numbers(rows, "series_id", "timestamp", "order"), 2048).drop("row_idx")
    return canonical(fixed, "kantine", "robotics", [n for n, _ in cols])


@loader("bosch_cnc")
def load_blocks(spark: SparkSession, path: str, factor: int = 10, files: int = 40) -> Loaded:
    """Vibration files (``x,y,z``) in folders ``good`` and ``bad``: the first ``files`` by name, means of ``factor`` rows."""
    raw = spark.read.options(header=True, inferSchema=True, recursiveFileLookup=True).csv(path)
    named = raw.select(F.concat_ws("/", folder_name(), file_stem()).alias("series_id"), *raw.columns, file_order().alias("order"), (folder_name() == "bad").cast("int").alias("label"))
    first = named.select("series_id").distinct().orderBy("series_id").limit(files)
    numbered = row_numbers_in_file(named).join(first, "series_id", "left_semi")
    whole = F.floor((F.max("row_idx").over(Window.partitionBy("series_id")) + 1) / factor)
    block = numbered.withColumn("block", F.floor(F.col("row_idx") / factor)).withColumn("whole", whole).where("block < whole")
    rows = block.groupBy("series_id", F.col("block").alias("row_idx")).agg(*(F.avg(c).alias(c) for c in raw.columns), F.max("label").alias("label"))
    fixed = runs.context_fix(rows, 2048).withColumn("timestamp", F.lit(EPOCH) + F.col("row_idx") * factor / 2000).withColumn("order", F.col("row_idx")).drop("row_idx")
    return canonical(fixed, "bosch_cnc", "manufacturing", raw.columns, synthetic=True)


def load_with_labels(source: str, sector: str, time: str, step: float) -> Callable[[SparkSession, str], Loaded]:
    """``train.csv`` (unknown), ``test.csv`` and ``test_label.csv``, whose rows go together by position."""

    def load(spark: SparkSession, path: str) -> Loaded:
        def part(name: str) -> DataFrame:
            raw = spark.read.options(header=True, inferSchema=True).csv(f"{path}/{name}.csv").withColumn("order", file_order()).withColumn("series_id", F.lit(name))
            return row_numbers_in_file(raw)

        train, test, marks = part("train"), part("test"), part("test_label")
        names = [c for c in train.columns if c not in (time, "order", "series_id", "row_idx")]
        mark = next(c for c in marks.columns if c not in (time, "order", "series_id", "row_idx"))
        known = test.join(marks.select("row_idx", F.col(f"`{mark}`").cast("int").alias("label")), "row_idx", "left")
        both = train.withColumn("label", F.lit(-1)).unionByName(known).withColumn("label", F.coalesce("label", F.lit(-1)))
        return canonical(both.withColumn("timestamp", F.lit(EPOCH) + step * F.col("row_idx")).drop("row_idx"), source, sector, names, synthetic=True)

    return load


LOADERS["psm"] = load_with_labels("psm", "it", "timestamp_(min)", 60.0)


@loader("ctf")
def load_machine_days(spark: SparkSession, path: str, unknown_days: int = 5, step: float = 30.0) -> Loaded:
    """Files ``machine_day`` of equal columns; days that are missing leave a gap; the first days are unknown.
    ``label_<machine>.csv`` has a label a row from the first labelled day on; rows beyond it are unknown."""
    lines = spark.read.options(header=True, inferSchema=True, pathGlobFilter="machine*.csv").csv(path)
    names = lines.columns
    part = lambda i: F.regexp_extract(file_stem(), r"^(.*)_(\d+)$", i)
    rows = lines.select(part(1).alias("series_id"), part(2).cast("int").alias("day"), file_order().alias("order"), *names)
    rows = row_numbers_in_file(rows, "slot")
    per_day = int(86400 / step)
    rows = rows.withColumn("at", F.col("day") * per_day + F.col("slot"))
    marks = spark.read.options(header=True, inferSchema=True, pathGlobFilter="label_*.csv").csv(path).select(F.regexp_replace(file_stem(), "^label_", "").alias("series_id"), F.col("label").cast("int").alias("label"), file_order().alias("order"))
    marks = row_numbers_in_file(marks).select("series_id", (F.col("row_idx") + unknown_days * per_day).alias("at"), "label")
    joined = rows.join(marks, ["series_id", "at"], "left").withColumn("label", F.when(F.col("day") < unknown_days, -1).otherwise(F.coalesce("label", F.lit(-1))))
    return canonical(joined.withColumn("timestamp", F.lit(EPOCH) + step * F.col("at")).drop("at", "day", "slot"), "ctf", "it", names, synthetic=True)


@loader("cats")
def load_causes(spark: SparkSession, path: str, train: float = 0.7, width: float = 3600.0) -> Loaded:
    """``data.csv`` (``timestamp``, channels, ``y``) and ``metadata.csv`` with a time span, a root cause and a list of affected channels
    for each anomaly: cells of these channels are anomalous. Rows that ``y`` marks and no span reaches count for all
    channels. The first part of the rows is the series ``train``, the rest ``val``."""
    raw = spark.read.options(header=True, inferSchema=True).csv(f"{path}/data.csv")
    names = [c for c in raw.columns if c not in ("timestamp", "y", "category")]
    at = lambda c: unix_seconds(F.to_timestamp(F.col(c).cast("string")))
    rows = raw.select(*names, F.coalesce(F.col("y").cast("double") > 0, F.lit(False)).alias("marked"), at("timestamp").alias("timestamp"), file_order().alias("order"), F.lit("all").alias("series_id"))
    meta = spark.read.options(header=True, escape='"').csv(f"{path}/metadata.csv")
    affected = F.from_json(F.translate("affected", "'", '"'), "array<string>")
    hit = F.array_union(F.array("root_cause"), F.coalesce(affected, F.array().cast("array<string>")))
    spans = meta.select(F.lit("all").alias("series_id"), at("start_time").alias("a"), at("end_time").alias("b"), F.array_intersect(hit, F.array(*map(F.lit, names))).alias("channels"))
    known = reshape.interval_channels(scans.numbered(rows, ("series_id",), ["timestamp", "order"]), spans, "timestamp", width)
    covered = F.size("channels") > 0
    label = F.array(*(F.when(covered, F.array_contains("channels", c)).otherwise(F.col("marked")).cast("int") for c in names))
    cut = F.floor(F.lit(known.count()) * train)
    part = F.when(F.col("row_idx") < cut, "train").otherwise("val")
    wide = known.select(*names, "timestamp", "order", label.alias("label"), part.alias("series_id"))
    return canonical(wide, "cats", "space", names, level="cell")


@loader("asd")
def load_servers(spark: SparkSession, path: str, step: float = 300.0) -> Loaded:
    """Files ``<server>_train.csv``, ``<server>_test.csv`` and ``<server>_test_label.csv`` without headers, rows by position: the test part
    goes on where the unknown training part ends."""
    def part(kind: str) -> DataFrame:
        lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=f"*_{kind}.csv").where("trim(value) != ''")
        server = F.regexp_extract("order.file", rf"([^/]+)_{kind}\.csv$", 1)
        lines = row_numbers_in_file(lines.select(F.split("value", ",").cast("array<double>").alias("v"), file_order().alias("order")))
        return lines.select(server.alias("server"), "row_idx", "v")

    train, test, marks = part("train"), part("test"), part("test_label")
    k = train.unionByName(test).agg(F.max(F.size("v"))).head()[0]
    marks = marks.select("server", "row_idx", F.element_at("v", 1).cast("int").alias("label"))
    known = test.join(marks, ["server", "row_idx"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    before = train.groupBy("server").agg(F.count("*").alias("before"))
    known = known.join(before, "server", "left").withColumn("at", F.col("row_idx") + F.coalesce("before", F.lit(0))).withColumn("part", F.lit("test"))
    both = train.select("server", "v", F.lit(-1).alias("label"), F.col("row_idx").alias("at"), F.lit("train").alias("part")).unionByName(known.select("server", "v", "label", "at", "part"))
    names = [f"metric_{i}" for i in range(k)]
    rows = both.select(F.concat_ws("/", "server", "part").alias("series_id"), (F.lit(EPOCH) + step * F.col("at")).alias("timestamp"), "label", F.col("at").alias("order"), *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return canonical(rows, "asd", "it", names, synthetic=True)


@loader("pvfault")
def load_plant(spark: SparkSession, path: str) -> Loaded:
    """CSV rows of voltages, currents, irradiance and module temperature with a fault code ``f_nv``, in the order of the file: short circuit,
    degradation and open circuit (1 to 3) are anomalies, shadows (4) unknown. Repaired by onset and context."""
    names = ["vdc1", "vdc2", "idc1", "idc2", "irr", "pvt"]
    raw = spark.read.options(header=True, inferSchema=True).csv(path)
    code = F.col("f_nv").cast("int")
    label = F.when(code.isin(1, 2, 3), 1).when(code == 4, -1).otherwise(0)
    rows = row_numbers_in_file(raw.select(*names, label.alias("label"), file_order().alias("order"))).withColumn("series_id", F.lit("plant"))
    fixed = runs.context_fix(rows, 2048).withColumn("timestamp", F.lit(EPOCH) + F.col("row_idx")).drop("row_idx")
    return canonical(fixed, "pvfault", "energy", names, synthetic=True)


def load_arrays(source: str, sector: str) -> Callable[[SparkSession, str], Loaded]:
    """Binary array files ``test/*.npy`` and ``train/*.npy`` and a CSV ``labeled_anomalies.csv`` with ``chan_id`` and inclusive
    row ranges of the test part as a list; several lists of one channel are joined. Labels are cells of the first channel."""

    def load(spark: SparkSession, path: str) -> Loaded:
        def unpack(frames):
            import io

            import numpy as np
            import pandas as pd

            for frame in frames:
                for name, content in frame[["path", "content"]].itertuples(index=False):
                    x = np.load(io.BytesIO(content)).astype(float)
                    x = x.reshape(len(x), -1)
                    where, stem = name.split("/")[-2:]
                    yield pd.DataFrame({"series_id": f"{where}/{stem.removesuffix('.npy')}", "order": np.arange(len(x)), "v": list(x)})

        # One file is one array: the largest thing a task holds.
        rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.npy").load(path).mapInPandas(unpack, "series_id string, order long, v array<double>")
        k = rows.agg(F.max(F.size("v"))).head()[0]
        raw = spark.read.options(header=True, quote='"', escape='"').csv(f"{path}/labeled_anomalies.csv")
        spans = raw.select(F.concat(F.lit("test/"), F.col("chan_id")).alias("series_id"), F.from_json("anomaly_sequences", "array<array<long>>").alias("s"))
        table = spans.groupBy("series_id").agg(F.flatten(F.collect_list("s")).alias("s")).select("series_id", F.explode("s").alias("p")).select("series_id", F.col("p")[0].cast("double").alias("a"), F.col("p")[1].cast("double").alias("b"), F.lit(1).alias("label"))
        marked = reshape.interval_label(rows.withColumn("row", F.col("order").cast("double")), table, "row", 1000.0)
        first = F.when(F.col("series_id").startswith("train/"), -1).otherwise(F.col("label"))
        rest = F.when(F.col("series_id").startswith("train/"), -1).otherwise(0)
        wide = marked.select("series_id", "order", *(F.get("v", F.lit(c)).alias(f"ch_{c}") for c in range(k)), F.array(first, *[rest] * (k - 1)).alias("label"), (F.lit(EPOCH) + 60 * F.col("order")).alias("timestamp"))
        return canonical(wide, source, sector, [f"ch_{c}" for c in range(k)], level="cell", synthetic=True)

    return load


LOADERS["smap"] = load_arrays("smap", "space")
LOADERS["msl"] = load_arrays("msl", "space")


@loader("esa_full")
def load_mission(spark: SparkSession, path: str, width: float = 600.0) -> Loaded:
    """Channels in files of their own (``time,value``), on a common grid of ``width`` seconds by mean; ``labels.csv`` has
    intervals by event and channel, ``anomaly_types.csv`` each event's category: anomalies are one, all else unknown."""
    raw = spark.read.options(header=True, inferSchema=True, pathGlobFilter="channel_*.csv").csv(path).select(file_stem().alias("channel"), unix_seconds(F.to_timestamp(F.col("time").cast("string"))).alias("t"), F.col("value").cast("double").alias("value"))
    names = [r[0] for r in raw.select("channel").distinct().orderBy("channel").collect()]  # a few channel names
    wide = raw.groupBy(F.lit("0").alias("series_id"), reshape.binned("t", width).alias("timestamp")).pivot("channel", names).agg(F.avg("value"))
    marks = spark.read.options(header=True, inferSchema=True).csv(f"{path}/labels.csv")
    kinds = spark.read.options(header=True, inferSchema=True).csv(f"{path}/anomaly_types.csv")
    spans = label_rules.categorised(marks, kinds, "ID", "Category", "Anomaly")
    at = lambda c: unix_seconds(F.to_timestamp(F.col(c).cast("string")))
    table = spans.select(F.col("Channel").alias("series_id"), at("StartTime").alias("a"), at("EndTime").alias("b"), "label")
    per = wide.select("timestamp").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "series_id string")))  # times by a few names
    cell = reshape.interval_label(per, table, "timestamp", 86400.0).groupBy("timestamp").pivot("series_id", names).agg(F.first("label"))
    cell = cell.select("timestamp", F.array(*(F.col(f"`{n}`") for n in names)).alias("label"))
    return canonical(wide.join(cell, "timestamp").withColumn("order", F.lit(0)), "esa_full", "space", names, level="cell")


LOADERS["esa"] = LOADERS["esa2"] = LOADERS["esa_full"]
LOADERS["bidmc"] = lambda spark, path: load_wide(spark, path, "bidmc", Wide("health", step=1.0, pattern="*.csv", drop=("Time [s]",)))


def part_of(load: Callable[[SparkSession, str], Loaded], source: str, group: Callable[[], Column], held: bool, share: float = 0.2) -> Callable[[SparkSession, str], Loaded]:
    """``load``'s series without the groups that are held out for validation, or only those, under the name ``source``.

    Groups are held out whole, by least hash: ``share`` of them, one at least.
    """
    def load_part(spark: SparkSession, path: str) -> Loaded:
        cells, catalog = load(spark, path)
        out = labels.holdout_ids(catalog.select(group().alias("part")), "part", share)
        how = "left_semi" if held else "left_anti"
        cells, catalog = (t.withColumn("part", group()).join(out, "part", how).select(*t.columns) for t in (cells, catalog))
        return cells, catalog.withColumn("source", F.lit(source)).withColumn("file", F.lit(pool_folder(source)))

    return load_part


#: What is held out together: wells (the start of a file's name), buildings, machines, flights.
GROUPS = {"w3": lambda: F.regexp_extract("series_id", r"([^/_]+)_[^/]*$", 1), "lead": lambda: F.col("series_id"), "ctf": lambda: F.col("series_id"), "alfa": lambda: F.col("series_id")}
for _name, _group in GROUPS.items():
    _load = LOADERS[_name]
    LOADERS[_name], LOADERS[f"{_name}_val"] = part_of(_load, _name, _group, False), part_of(_load, f"{_name}_val", _group, True)


#: Sectors of a mixed archive's subsets by their names' starts, the first match counts; subsets that only
#: repeat another one's other years.
SECTORS = (
    ("BEIJING_SUBWAY|HZMETRO|SHMETRO|LOOP_SEATTLE|LOS_LOOP|M_DENSE|PEMS|Q-TRAFFIC|SZ_TAXI|taxi_|uber_tlc|traffic_|pedestrian|rideshare|vehicle_trips|largest_|covid_mobility", "transport"),
    ("australian_electricity|bdg-2|buildings_900k|covid19_energy|elecdemand|elf|gfc1|ideal|lcl|london_smart|residential_|solar_power|wind_power|wind_farms|spain|smart|sceaux|borealis|bull|cockatoo|hog|pdb|kdd2022", "energy"),
    ("era5|cmip6|weather|oikolab|subseasonal|temperature_rain|china_air|beijing_air|kdd_cup_2018|saugeenday|sunspot", "environment"),
    ("borg_cluster|azure_vm|alibaba_cluster|extended_web_traffic|kaggle_web_traffic|wiki-rolling", "it"),
    ("favorita|m5|restaurant|hierarchical_sales|car_parts|godaddy", "retail"),
    ("bitcoin|fred_md|nn5", "finance"),
    ("hospital|covid_deaths|cdc_fluview|project_tycho|us_births", "health"),
    ("tourism", "tourism"),
    ("m1_|m3_|m4_|monash_m3|cif_2016", "mixed_business"),
)
REPEATED_YEARS = "^(era5_(?!2018)|cmip6_(?!2010)|largest_(?!2021))"


def sector_of(subset: Column) -> Column:
    sector = F.lit("unknown")
    for pattern, name in reversed(SECTORS):
        sector = F.when(subset.rlike(f"^({pattern})"), name).otherwise(sector)
    return sector


@loader("lotsa")
def load_nested(spark: SparkSession, path: str, series_: int = 200, least: int = 64, most: int = 10_000) -> Loaded:
    """Rows with a start, a frequency in seconds and a nested array of targets; at most ``series_`` series of least hash of
    the subset that the path's last folder names, each cut to ``most`` steps from a start by hash."""
    raw = spark.read.parquet(path).select(F.col("item_id").cast("string").alias("series_id"), "start", F.col("freq_s").cast("double").alias("step"), "target").where(F.size(F.element_at("target", 1)) >= least)
    some = raw.orderBy(F.xxhash64("series_id"), "series_id").limit(series_)
    k = some.agg(F.max(F.size("target"))).head()[0]
    n = F.size(F.element_at("target", 1))
    begin = F.pmod(F.xxhash64("series_id"), F.greatest(n - most + 1, F.lit(1))).cast("int")
    cut = some.withColumn("begin", begin)
    rows = cut.select("series_id", unix_seconds("start").alias("t0"), "step", "begin", F.posexplode(F.arrays_zip(*(F.slice(F.element_at("target", c + 1), F.col("begin") + 1, most).alias(f"ch_{c}") for c in range(k)))).alias("order", "x"))
    wide = rows.select("series_id", (F.col("t0") + F.col("step") * (F.col("begin") + F.col("order"))).alias("timestamp"), *(F.col(f"x.ch_{c}").alias(f"ch_{c}") for c in range(k)), F.lit(-1).alias("label"), "order")
    cells, catalog = canonical(wide, "lotsa", "unknown", [f"ch_{c}" for c in range(k)])
    return cells, catalog.withColumn("sector", sector_of(F.lit(path.rstrip("/").split("/")[-1])))


def smallest_files(files: DataFrame) -> DataFrame:
    """The smallest file of each subset (``subset, file, size``), its sector by name; subsets of repeated years go."""
    wanted = files.where(~F.col("subset").rlike(REPEATED_YEARS))
    return wanted.groupBy("subset").agg(F.min_by("file", F.struct("size", "file")).alias("file")).withColumn("sector", sector_of(F.col("subset")))


def write_pool(cells: DataFrame, path: str, source: str) -> None:
    """One source's cells in the pool: compressed Parquet, a folder a source, sorted for row-group pruning by series."""
    ready = cells.withColumn("source", F.lit(source))
    ready.repartition("series_id").sortWithinPartitions("series_id", "row_idx", "channel").write.mode("append").option("compression", "zstd").partitionBy("source").parquet(path)


def read_series(spark: SparkSession, path: str, series_ids: list[str], source: str | None = None) -> DataFrame:
    """Cells of single series: both filters reach the scan."""
    pool = spark.read.parquet(path)
    if source:
        pool = pool.where(F.col("source") == source)
    return pool.where(F.col("series_id").isin(series_ids))
