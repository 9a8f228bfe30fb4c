"""Streaming versions of the operators that need ordered state.

All take and return streaming frames (``readStream`` to ``writeStream``); rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import windows
from ..operators.scoring import row_scores


def binned_counts(events: DataFrame, t: str, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Tumbling bins of a log: rows, errors, any alert."""
    return events.withWatermark(t, late).groupBy(F.window(t, width)).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("largest")
    ).select(F.col("window.start").alias("bin"), "total", "errors", "largest")


def sliding_means(cells: DataFrame, t: str, size: str, slide: str, late: str) -> DataFrame:
    """Sliding-window means by series and channel."""
    return cells.withWatermark(t, late).groupBy("series_id", "channel", F.window(t, size, slide)).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("series_id", "channel", F.col("window.start").alias("start"), "value", "n")


def merged_duplicates(cells: DataFrame, t: str, late: str) -> DataFrame:
    """Equal ``(series_id, t, channel)`` as one with the mean of the values, out of order or not."""
    return cells.withWatermark(t, late).groupBy("series_id", "channel", F.window(t, "1 microsecond")).agg(F.avg("value").alias("value")).select("series_id", "channel", F.col("window.start").alias(t), "value")


def anomaly_sessions(rows: DataFrame, t: str, gap: str, late: str) -> DataFrame:
    """Events as sessions of anomalous rows no further apart than ``gap``."""
    hot = rows.where("anomaly = 1").withWatermark(t, late)
    return hot.groupBy("series_id", F.session_window(t, gap)).agg(F.count("*").alias("n"), F.max("score").alias("confidence")).select("series_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "confidence")


def open_events(rows: DataFrame, t: str, late: str = "10 minutes") -> DataFrame:
    """Events that stay open until a normal row arrives: one row when an event closes.

    Rows are taken in order of time, in whatever order they arrive: a row waits in the state until the watermark has
    passed it. State of a series: start, last time, rows and largest score of its open event, and the rows of the last
    ``late`` that wait. ``rows`` has ``series_id`` (long), the time, ``score, anomaly``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, top, passed, times, scores, flags = state.get if state.exists else (0, 0, 0, 0.0, -(1 << 62), [], [], [])
        waiting = [*zip(times, scores, flags, strict=True)]
        for frame in frames:
            frame = frame[frame["at_"] > passed]  # else later than the watermark
            waiting += zip(frame["at_"].tolist(), frame["score"].tolist(), frame["anomaly"].tolist(), strict=True)
        waiting.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        done = 0
        closed = []
        for at, score, flag in waiting:
            if at > mark:
                break
            done += 1
            if flag == 1:
                start, last, n, top = (start if n else at), at, n + 1, max(top, score)
            elif n:
                closed.append((key[0], start, last, n, top))
                start, last, n, top = 0, 0, 0, 0.0
        waiting = waiting[done:]
        times, scores, flags = ([w[k] for w in waiting] for k in range(3))
        state.update((start, last, n, top, max(passed, mark), times, scores, flags))
        if waiting:  # back when the watermark has passed the first one
            state.setTimeoutTimestamp(max(times[0] // 1000, mark // 1000) + 1)
        yield pd.DataFrame(closed, columns=["series_id", "start", "stop", "n", "confidence"])

    out = "series_id long, start long, stop long, n long, confidence double"
    held = "start long, last long, n long, top double, passed long, times array<long>, scores array<double>, flags array<int>"
    timed = rows.withWatermark(t, late).select("series_id", t, F.unix_micros(F.col(t).cast("timestamp")).alias("at_"), F.col("score").cast("double").alias("score"), F.col("anomaly").cast("int").alias("anomaly"))
    made = timed.groupBy("series_id").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("series_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n", "confidence")


@dataclass
class Fold:
    """Windows of one series' rows as they come, each scored against the last calm one: what ``scoring.fold_windows`` does for
    a series at hand. Rows before ``first`` are done with; the buffer has those that a later window may still cover."""

    size: int
    stride: int
    threshold: float
    scorer: windows.Predict
    how: str
    k: int
    channels: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    total: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reference: np.ndarray | None = None
    first: int = 0  #: number of the buffer's first row
    start: int = 0  #: buffer place of the next window
    covered: int = 0  #: buffer rows that a window has covered

    def know(self, channels: set[int]) -> None:
        """Make room for channels that weren't there before: their earlier values are missing."""
        every = sorted({*self.channels, *channels})
        if every == self.channels:
            return
        place = [every.index(c) for c in self.channels]

        def wider(old: np.ndarray, blank: float) -> np.ndarray:
            out = np.full((len(old), len(every)), blank)
            out[:, place] = old
            return out

        self.x, self.total = wider(self.x, np.nan), wider(self.total, 0.0)
        self.reference = None if self.reference is None else windows.filled(wider(self.reference, np.nan))
        self.channels = every

    def push(self, time: int, values: dict[int, float]) -> list[tuple[int, int, np.ndarray]]:
        """Add a row; rows that are done come back as ``(number, time, probabilities)``."""
        row = np.array([[values.get(c, np.nan) for c in self.channels]])
        self.times.append(time)
        self.x, self.total, self.weight = np.concatenate([self.x, row]), np.concatenate([self.total, np.zeros(row.shape)]), np.append(self.weight, 0.0)
        if len(self.times) - self.start < self.size:
            return []
        self._score(self.start, self.size)
        # The next window begins after this one's first row, wherever the series ends.
        done = self._leave(self.start + 1)
        self.start += self.stride
        return done

    def flush(self) -> list[tuple[int, int, np.ndarray]]:
        """The series ends here: its last window ends with it. The reference stays for what may come."""
        n = len(self.times)
        if n > self.covered:
            rows = min(n, self.size)
            self._score(n - rows, rows)
        done = self._leave(n)
        self.start = self.covered = 0
        return done

    def _score(self, start: int, rows: int) -> None:
        part = windows.filled(self.x[start : start + rows])
        z = windows.scaled_by(part, part if self.reference is None else self.reference)
        seconds = np.array(self.times[start : start + rows]) / 1e6
        p = np.asarray(self.scorer(windows.batch_of([(z, seconds)]))[0], float)
        w = windows.weights(rows)
        self.total[start : start + rows] += p * w[:, None]
        self.weight[start : start + rows] += w
        self.covered = start + rows
        if row_scores(p[rows * 3 // 4 :], self.how, self.k).max() < self.threshold:
            self.reference = part

    def _leave(self, n: int) -> list[tuple[int, int, np.ndarray]]:
        p = self.total[:n] / np.maximum(self.weight[:n, None], 1e-8)
        done = [(self.first + i, self.times[i], p[i]) for i in range(n)]
        self.times, self.x, self.total, self.weight = self.times[n:], self.x[n:], self.total[n:], self.weight[n:]
        self.first, self.start, self.covered = self.first + n, self.start - n, self.covered - n
        return done


def frozen_scores(cells: DataFrame, t: str, size: int, stride: int | None = None, threshold: float = 0.5, late: str = "10 minutes", idle: float = 3600.0, scorer: windows.Predict = windows.robust_z, how: str = "topk", k: int = 3, group: int = windows.GROUP) -> DataFrame:
    """``series_id, row_idx, t, channel, p``: overlapping windows of ``size`` rows, scored against the last one that ended calm and blended.

    ``cells``: ``series_id`` (long), a timestamp ``t``, ``channel, value``. Cells of one time are a row, equal ones averaged. Rows are
    taken in order of time, in whatever order they arrive: a cell waits until the watermark has passed it, and later ones are
    dropped. A series that rests for more than ``idle`` seconds ends there: its last rows are scored by a window that ends with them, and what
    comes after begins a new row of windows, with the reference it had. State of a series and ``group`` of channels: the
    reference, at most ``size + stride`` rows, and the cells of the last ``late`` that wait.
    """
    step_rows, rest = stride or size // 2, int(idle * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(size, step_rows, threshold, scorer, how, k)
        waiting = []
        if state.exists:
            last, at, channel, value, fold.channels, fold.times, x, total, weight, reference, fold.first, fold.start, fold.covered = state.get
            wide = len(fold.channels)
            fold.channels, fold.times = list(fold.channels), list(fold.times)
            fold.x, fold.total = (np.array(v, float).reshape(-1, wide) if wide else np.zeros((0, 0)) for v in (x, total))
            fold.weight = np.array(weight, float)
            fold.reference = np.array(reference, float).reshape(-1, wide) if len(reference) else None
            waiting = [*zip(at, channel, value, strict=True)]
        else:
            last = None
        mark = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            if mark > 0:  # there is one
                frame = frame[frame["at_"] > mark]
            waiting += zip(frame["at_"].tolist(), frame["channel"].tolist(), frame["value"].astype(float).tolist(), strict=True)
        waiting.sort(key=lambda w: w[:2])
        ready, waiting = [w for w in waiting if w[0] <= mark], [w for w in waiting if w[0] > mark]
        rows: dict[int, dict[int, list[float]]] = {}
        for at, channel, value in ready:
            rows.setdefault(at, {}).setdefault(channel, []).append(value)
        fold.know({c for row in rows.values() for c in row})
        done = []
        for at, row in rows.items():
            if last is not None and at - last > rest:
                done += fold.flush()
            finite = {c: [v for v in values if np.isfinite(v)] for c, values in row.items()}
            done += fold.push(at, {c: sum(v) / len(v) for c, v in finite.items() if v})
            last = at
        if fold.times and mark - last > rest:
            done += fold.flush()
        at, channel, value = ([w[i] for w in waiting] for i in range(3))
        reference = [] if fold.reference is None else fold.reference.ravel().tolist()
        kept = (last, at, channel, value, fold.channels, fold.times, fold.x.ravel().tolist(), fold.total.ravel().tolist(), fold.weight.tolist(), reference, fold.first, fold.start, fold.covered)
        state.update(kept)
        next_ = [waiting[0][0]] if waiting else []
        next_ += [last + rest] if fold.times else []
        if next_:
            state.setTimeoutTimestamp(max(min(next_) // 1000, mark // 1000) + 1)
        n = len(fold.channels)
        yield pd.DataFrame({
            "series_id": np.full(len(done) * n, key[0], np.int64), "row_idx": np.repeat(np.array([d[0] for d in done], np.int64), n), "at": np.repeat(np.array([d[1] for d in done], np.int64), n),
            "channel": np.tile(np.array(fold.channels, np.int32), len(done)), "p": np.concatenate([d[2] for d in done]) if done else np.zeros(0),
        })

    out = "series_id long, row_idx long, at long, channel int, p double"
    held = "last long, at array<long>, channel array<int>, value array<double>, channels array<int>, times array<long>, x array<double>, total array<double>, weight array<double>, reference array<double>, first long, start long, covered long"
    timed = cells.withWatermark(t, late).select("series_id", t, F.unix_micros(F.col(t).cast("timestamp")).alias("at_"), F.col("channel").cast("int").alias("channel"), F.col("value").cast("double").alias("value"), F.floor(F.col("channel") / group).alias("block"))
    made = timed.groupBy("series_id", "block").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("series_id", "row_idx", F.timestamp_micros("at").alias(t), "channel", "p")
