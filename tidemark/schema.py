"""Column layouts and constants shared by all operators.

Series are held in long form, one row a cell. ``(series_id, row_idx, channel)`` is the key: timestamps may repeat,
so they don't identify a row. Missing values are null, never NaN.
"""

from __future__ import annotations

CELLS = "series_id string, row_idx long, timestamp double, channel int, value double, label int"
CATALOG = (
    "series_id string, source string, sector string, n_rows long, n_channels int, step_s double, label_level string, "
    "anomaly_row_ratio double, unlabeled boolean, synthetic_time boolean, benchmark string, license string, "
    "channel_names string, label_confidence double, label_quality string, note string, file string"
)

ROW = ("series_id", "row_idx")
CHANNEL = ("series_id", "channel")

#: The anomaly types by id.
TYPES = ("normal", "spike", "level_shift", "flatline", "drift", "noise_burst", "pattern_change", "correlation_break", "missing_data")

#: Labels: an anomaly, a normal cell, an unknown one.
ANOMALY, NORMAL, UNKNOWN = 1, 0, -1

#: Rows of a scoring window; rows from which a series is scored by windows.
MAX_T, MIN_T = 4096, 20
#: Rows of context before an event: at most this many, or this share of the series.
CONTEXT_ROWS, CONTEXT_SHARE = 256, 10
#: Weight of a cell with unknown label.
UNKNOWN_WEIGHT = 0.05
#: Half-widths, in rows, of label dilation for the range-tolerant metric.
BUFFERS = (0, 16, 64, 256)
