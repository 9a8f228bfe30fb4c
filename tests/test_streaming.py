"""Streams give what the batch operators give."""

import datetime
import json
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring, windows
from tidemark.streaming import stateful


def stream(spark, folder, batches, schema):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i:03}.json", (1_700_000_000 + 60 * i,) * 2)  # the order in which files are read
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(df, folder, mode="append"):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(second):
    return f"2024-01-01T{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}.000Z"


def test_bins_with_late_rows(spark, tmp_path):
    first = [{"t": at(s), "event_type": "error" if s % 20 == 0 else "view", "value": float(s)} for s in range(0, 120, 10)]
    late = [{"t": at(5), "event_type": "error", "value": 1.0}, {"t": at(3000), "event_type": "view", "value": 1.0}]
    events = stream(spark, tmp_path / "in", [first, late], "t timestamp, event_type string, value double")
    got = collected(stateful.binned_counts(events, "t", late="1 minute"), tmp_path / "c", "complete")
    assert sorted((r["total"], r["errors"]) for r in got)[-2:] == [(6, 3), (7, 4)]


def test_open_events_span_batches(spark, tmp_path):
    """Files in any order, rows within them, too: events are those of the rows in order of time."""
    flags = [0, 1, 1, 1, 0, 0, 1, 0]
    rows = [{"series_id": 1, "t": at(i), "score": 0.1 * i, "anomaly": a} for i, a in enumerate(flags)]
    last = [{"series_id": 1, "t": at(3000), "score": 0.0, "anomaly": 0}]
    for k, parts in enumerate(([rows[:3], rows[3:6], rows[6:], last], [rows[6:], rows[2:6][::-1], rows[:2], last])):
        events = stateful.open_events(stream(spark, tmp_path / f"in{k}", parts, "series_id long, t timestamp, score double, anomaly int"), "t", "1 minute")
        got = sorted((r["start"].second, r["stop"].second, r["n"], round(r["confidence"], 6)) for r in collected(events, tmp_path / f"c{k}"))
        assert got == [(1, 3, 3, 0.3), (6, 6, 1, 0.6)]


def test_late_rows_of_open_events_are_dropped(spark, tmp_path):
    rows = [{"series_id": 1, "t": at(i), "score": 0.5, "anomaly": int(i in (1000, 1001))} for i in (0, 1000, 1001, 1002)]
    more = [{"series_id": 1, "t": at(1500), "score": 0.0, "anomaly": 0}]
    late = [{"series_id": 1, "t": at(5), "score": 0.9, "anomaly": 1}, {"series_id": 1, "t": at(3000), "score": 0.0, "anomaly": 0}]
    events = stateful.open_events(stream(spark, tmp_path / "in", [rows, more, late], "series_id long, t timestamp, score double, anomaly int"), "t", "1 minute")
    assert [(r["n"], r["confidence"]) for r in collected(events, tmp_path / "c")] == [(2, 0.5)]


def frozen_rows():
    """Two channels, values missing, a level that stays, and a rest of an hour and a half before the last 21 rows."""
    rng = random.Random(5)
    rows = []
    for i in range(96):
        second = i + (5_400 if i >= 75 else 0)
        for c in range(2):
            if rng.random() < 0.9:
                value = rng.gauss(0, 1) + (9 if rng.random() < 0.05 else 0) + (30 if i >= 40 else 0)
                rows.append({"series_id": 1, "t": at(second), "channel": c, "value": value})
    return rows


def folded(rows, size, stride):
    """The same by the batch fold, part by part; the reference of a part goes on in the next one."""
    times = sorted({r["t"] for r in rows})
    x = np.full((len(times), 2), np.nan)
    for r in rows:
        x[times.index(r["t"]), r["channel"]] = r["value"]
    fold = stateful.Fold(size, stride, 0.5, windows.robust_z, "topk", 3)
    cut = sum(t < at(3_000) for t in times)
    first = scoring.fold_windows(x[:cut], size, stride, 0.5)
    fold.know({0, 1})
    done = []
    for i, row in enumerate(x):
        if i == cut:
            done += fold.flush()
        done += fold.push(int(datetime.datetime.fromisoformat(times[i]).timestamp() * 1e6), dict(enumerate(row)))
    done += fold.flush()
    p = np.array([d[2] for d in done])
    assert [d[0] for d in done] == list(range(len(x))) and p[:cut] == pytest.approx(first, abs=1e-9)
    return p


@pytest.mark.parametrize(("size", "stride"), [(16, 8), (16, 16), (100, 50), (10, 7)])
def test_frozen_scores_equal_the_batch_fold(spark, tmp_path, size, stride):
    rows = frozen_rows()
    want = folded(rows, size, stride)
    near, far = [r for r in rows if r["t"] < at(3_000)], [r for r in rows if r["t"] > at(3_000)]
    shuffled = random.Random(1).sample(near, len(near))
    end = [[{"series_id": 2, "t": at(s), "channel": 0, "value": 0.0}] for s in (9_000, 20_000, 20_001)]  # move the watermark
    late = [{"series_id": 1, "t": at(10), "channel": 0, "value": 99.0}]
    for k, parts in enumerate(([near, far, *end], [shuffled[:40], shuffled[40:], far[::-1], late, *end])):
        scores = stateful.frozen_scores(stream(spark, tmp_path / f"in{k}", parts, "series_id long, t timestamp, channel int, value double"), "t", size, stride, late="10 minutes", idle=3_600.0)
        got = {(r["row_idx"], r["channel"]): r["p"] for r in collected(scores, tmp_path / f"c{k}") if r["series_id"] == 1}
        assert len(got) == want.size
        assert np.array([[got[i, c] for c in range(2)] for i in range(len(want))]) == pytest.approx(want, abs=1e-9)


def test_sessions_and_duplicates(spark, tmp_path):
    rows = [{"series_id": 1, "channel": 0, "t": at(s), "value": float(s), "score": 0.9, "anomaly": int(s in (1, 2, 40))} for s in (0, 1, 1, 2, 40, 900)]
    schema = "series_id long, channel int, t timestamp, value double, score double, anomaly int"
    merged = collected(stateful.merged_duplicates(stream(spark, tmp_path / "a", [rows], schema), "t", "1 minute"), tmp_path / "c1", "complete")
    assert len(merged) == 5
    hot = rows + [{**rows[-1], "anomaly": 1, "t": at(3000)}]
    sessions = collected(stateful.anomaly_sessions(stream(spark, tmp_path / "b", [hot], schema), "t", "10 seconds", "1 minute"), tmp_path / "c2", "append")
    assert sorted(r["n"] for r in sessions)[-1] == 3
    assert spark.range(1).select(F.lit(1)).first()[0] == 1
