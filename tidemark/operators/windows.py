"""Windows of series as padded arrays, for scorers that take whole windows.

A window is the rows ``start`` to ``start + size`` of a series and a group of its channels. Cells are dealt by window and
sorted; a task puts windows together as their cells stream in, prepares each by itself and hands them to the scorer in
batches bounded by bytes. What a window's score is doesn't depend on the batch it came in, nor on partitions.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series

#: Channels of a window at most, and bytes of a batch of windows.
GROUP = 100
BATCH_BYTES = 64 << 20


@dataclass
class Batch:
    """Windows, padded with zeros to the longest and the widest of them: ``values`` (windows, rows, channels) in robust units,
    ``delta_t`` (windows, rows), and masks of what isn't padding."""

    values: np.ndarray
    delta_t: np.ndarray
    time_mask: np.ndarray
    channel_mask: np.ndarray


#: From a batch to probabilities of the shape of its ``values``.
Predict = Callable[[Batch], np.ndarray]


def filled(x: np.ndarray) -> np.ndarray:
    """Columns with missing values (NaN) filled: the last value seen, before the first one the column's median thereafter, 0 if none."""
    known = ~np.isnan(x)
    if known.all():
        return x.copy()
    at = np.maximum.accumulate(np.where(known, np.arange(len(x))[:, None], 0), axis=0)
    out = np.take_along_axis(x, at, axis=0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # columns without values
        typical = np.nanmedian(out, axis=0)
    return np.where(np.isnan(out), np.where(np.isnan(typical), 0.0, typical), out)


def centre_and_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = np.median(x, 0)
    mad, deviation = np.median(np.abs(x - centre), 0) * 1.4826, x.std(0)
    return centre, np.where(mad > 1e-8, mad, np.where(deviation > 1e-8, deviation, 1.0))


def scaled_by(x: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """``x`` in robust units of ``reference``; columns are channels."""
    centre, scale = centre_and_scale(reference)
    return np.clip((x - centre) / scale, -50, 50)


def steps(t: np.ndarray) -> np.ndarray:
    """Log of one plus the step to the row before over the median step; 0 at first."""
    d = np.diff(t)
    return np.concatenate([[0.0], np.log1p(d / max(float(np.median(d)), 1e-12))]) if len(d) else np.zeros(len(t))


def batch_of(windows: list[tuple[np.ndarray, np.ndarray]]) -> Batch:
    """``windows``: values in robust units, and times."""
    rows, channels = max(len(z) for z, _ in windows), max(z.shape[1] for z, _ in windows)
    out = Batch(np.zeros((len(windows), rows, channels)), np.zeros((len(windows), rows)), np.zeros((len(windows), rows), bool), np.zeros((len(windows), channels), bool))
    for i, (z, t) in enumerate(windows):
        out.values[i, : len(z), : z.shape[1]] = z
        out.delta_t[i, : len(z)] = steps(t)
        out.time_mask[i, : len(z)] = True
        out.channel_mask[i, : z.shape[1]] = True
    return out


def robust_z(batch: Batch) -> np.ndarray:
    """Probabilities from the robust z-scores."""
    return np.clip(1 - np.exp(-np.maximum(np.abs(batch.values) - 3, 0)), 0, 1)


def weights(n: int) -> np.ndarray:
    return (1 - np.abs(np.linspace(-1, 1, n))) * 0.9 + 0.1


@dataclass
class _Open:
    """A window whose cells are arriving, row by row."""

    key: tuple
    row_idx: np.ndarray
    channel: np.ndarray
    value: np.ndarray
    timestamp: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    length: int

    def matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values in robust units, times, row numbers and channels; cells that are absent are missing."""
        rows, i = np.unique(self.row_idx, return_inverse=True)
        channels, c = np.unique(self.channel, return_inverse=True)
        x, t = np.full((len(rows), len(channels)), np.nan), np.zeros(len(rows))
        x[i, c], t[i] = self.value, self.timestamp
        x = filled(x)
        centre, scale = np.full(len(channels), np.nan), np.ones(len(channels))
        centre[c], scale[c] = self.centre, self.scale
        if np.isnan(centre).any():  # no reference
            centre, scale = centre_and_scale(x)
        return np.clip((x - centre) / scale, -50, 50), t, rows, channels


def _arriving(batches: Iterator[pa.RecordBatch]) -> Iterator[_Open]:
    """Whole windows from cells sorted by window."""
    held: list[pa.RecordBatch] = []

    def joined() -> _Open:
        table = pa.Table.from_batches(held)
        arrays = [np.concatenate([np.asarray(c.to_numpy(zero_copy_only=False), kind) for c in table.column(n).chunks]) for n, kind in (("row_idx", np.int64), ("channel", np.int64), ("value", float), ("timestamp", float), ("centre", float), ("scale", float))]
        return _Open((table.column("series_id")[0].as_py(), table.column("start")[0].as_py()), *arrays, table.column("length")[0].as_py())

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column(batch.schema.get_field_index("window")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            key = tuple(part.column(part.schema.get_field_index(n))[0].as_py() for n in ("series_id", "start", "block"))
            if held and key != last:
                yield joined()
                held = []
            last = key
            held.append(part)
    if held:
        yield joined()


def window_scores(cells: DataFrame, size: int, stride: int, predict: Predict = robust_z, reference: DataFrame | None = None, group: int = GROUP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``series_id, row_idx, channel, p``: all windows scored by ``predict`` and blended by triangle weights.

    Each window is filled and scaled by itself, or by ``reference`` (``series_id, channel, centre, scale``) where that has
    its channels. ``cells`` has ``series_id, row_idx, channel, value``, and ``timestamp`` if times differ from row numbers.
    """
    kind = dict(cells.dtypes)["series_id"]
    time = F.col("timestamp") if "timestamp" in cells.columns else F.col("row_idx")
    cells = cells.select("series_id", "row_idx", F.col("channel").cast("int").alias("channel"), F.col("value").cast("double").alias("value"), time.cast("double").alias("timestamp"))
    nothing = (F.lit(None).cast("double").alias("centre"), F.lit(None).cast("double").alias("scale"))
    cells = cells.select("*", *nothing) if reference is None else cells.join(reference.select("series_id", "channel", "centre", "scale"), ["series_id", "channel"], "left")
    dealt = series.in_windows(cells, size, stride).withColumn("block", F.floor(F.col("channel") / group))
    names = ["series_id", "start", "block"]
    dealt = dealt.select(*names, F.xxhash64(*names).alias("window"), "row_idx", "channel", "value", "timestamp", "centre", "scale", "length").repartition(*names).sortWithinPartitions(*names, "row_idx", "channel")
    out = f"series_id {kind}, row_idx long, channel int, score double, place long, length long"

    def scored(windows: list[tuple]) -> Iterator[pa.RecordBatch]:
        p = predict(batch_of([(z, t) for _, _, z, t, _, _ in windows]))
        for i, (key, length, z, _, rows, channels) in enumerate(windows):
            n, k = z.shape
            place = rows - key[1]
            arrays = [pa.array([key[0]] * (n * k)), pa.array(np.repeat(rows, k)), pa.array(np.tile(channels, n).astype(np.int32)), pa.array(np.asarray(p[i, :n, :k], float).ravel())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.repeat(place, k)), pa.array(np.full(n * k, length, np.int64))], ["series_id", "row_idx", "channel", "score", "place", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = channels = 0
        for window in _arriving(batches):
            z, *rest = window.matrices()
            rows, channels = max(rows, len(z)), max(channels, z.shape[1])
            if held and (len(held) + 1) * rows * channels * 8 > batch_bytes:
                yield from scored(held)
                held, rows, channels = [], len(z), z.shape[1]
            held.append((window.key, window.length, z, *rest))
        if held:
            yield from scored(held)

    return series.blend(dealt.mapInArrow(run, out), ("series_id", "row_idx", "channel")).select("series_id", "row_idx", "channel", F.col("score").alias("p"))
