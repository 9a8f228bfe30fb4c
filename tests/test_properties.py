"""Operators against plain re-derivations on many random series at once, and properties of the small functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import generate, metrics, runs, series, windows


@pytest.fixture(scope="module")
def marks():
    rng = np.random.default_rng(11)
    return {s: rng.choice([0, 0, 0, 1, 1, -1], int(rng.integers(1, 60))).tolist() for s in range(60)}


@pytest.fixture(scope="module")
def rows(spark, marks):
    return spark.createDataFrame([(s, i, y) for s, ys in marks.items() for i, y in enumerate(ys)], "series_id long, row_idx long, label int").repartition(5, "row_idx")


def spans(ys):
    out, start = [], None
    for i, y in enumerate([*ys, 0]):
        if y == 1 and start is None:
            start = i
        if y != 1 and start is not None:
            out.append((start, i))
            start = None
    return out


def by_series(df, name="label"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["series_id"], r["row_idx"])):
        out.setdefault(r["series_id"], []).append(r[name])
    return out


def test_runs(rows, marks):
    got = {}
    for r in runs.runs(rows).collect():
        got.setdefault(r["series_id"], []).append((r["start"], r["stop"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: spans(ys) for s, ys in marks.items() if spans(ys)}
    assert sum(b - a for v in got.values() for a, b in v) == sum(y == 1 for ys in marks.values() for y in ys)


def cut(ys, onset):
    out = list(ys)
    for a, b in spans(ys):
        out[a + onset : b] = [-1] * max(0, b - a - onset)
    return out


@pytest.mark.parametrize("onset", [1, 3])
def test_onset_cut(rows, marks, onset):
    assert by_series(runs.onset_cut(rows, onset)) == {s: cut(ys, onset) for s, ys in marks.items()}


def test_context_fix(rows, marks):
    want = {}
    for s, ys in marks.items():
        out = cut(ys, 4)
        for a, b in spans(out):
            if sum(y == 0 for y in out[:a]) < min(5, len(out) // 10):
                out[a:b] = [-1] * (b - a)
        want[s] = out
    assert by_series(runs.context_fix(rows, 4, most=5)) == want


def test_audit(rows, marks):
    for r in runs.audit(rows).collect():
        ys = marks[r["series_id"]]
        found, known = spans(ys), [y for y in ys if y >= 0]
        first = found[0][0] if found else len(ys)
        assert (r["n"], r["known"], r["events"]) == (len(ys), len(known), len(found))
        assert r["longest"] == max((b - a for a, b in found), default=0) and r["context"] == sum(y == 0 for y in ys[:first])
        assert r["ratio"] == (None if not known else pytest.approx(sum(y == 1 for y in ys) / len(known)))


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(5)
    data = {s: (rng.integers(0, 2, 40), rng.integers(0, 12, 40) / 11) for s in range(12)}
    made = spark.createDataFrame([(s, i, int(y), float(p)) for s, (ys, ps) in data.items() for i, (y, p) in enumerate(zip(ys, ps, strict=True))], "series_id long, row_idx long, label int, score double")
    for r in metrics.ranking(made).collect():
        y, p = data[r["series_id"]]
        pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
        assert r["roc_auc"] == pytest.approx(np.mean(pairs))
        ap, last, best = 0.0, 0.0, 0.0
        for t in sorted(set(p), reverse=True):
            hit = p >= t
            tp = y[hit].sum()
            ap += (tp / y.sum() - last) * tp / hit.sum()
            last = tp / y.sum()
            best = max(best, 2 * tp / (hit.sum() + y.sum()))
        assert (r["average_precision"], r["best_f1"]) == pytest.approx((ap, best))


def test_fill_leaves_no_gaps(spark):
    rng = np.random.default_rng(6)
    made = spark.createDataFrame([(s, i, 0, None if rng.random() < 0.4 else float(rng.normal())) for s in range(20) for i in range(int(rng.integers(1, 30)))], "series_id long, row_idx long, channel int, value double")
    out = series.fill(made).toPandas().sort_values(["series_id", "row_idx"])
    for _, g in out.groupby("series_id"):
        forward = g["value"].ffill()
        want = forward.fillna(forward.median() if forward.notna().any() else 0.0)
        assert np.allclose(g["filled"], want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=3, max_size=60))
def test_scaling_is_bounded_and_centred(xs):
    x = np.array(xs)[:, None]
    z = windows.scaled_by(x, x)
    assert np.isfinite(z).all() and np.abs(z).max() <= 50 and (np.median(z) == pytest.approx(0, abs=1e-6) or len(xs) % 2 == 0)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(64, 200))
def test_samples_are_labelled_where_they_changed(seed, rows):
    s, name, faults = generate.make(seed, 7, rows, sorted(generate.DOMAINS))
    assert np.isfinite(s.x).all() and s.x.shape == s.label.shape and ((s.label == 1) == (s.type > 0)).all()
    assert bool(faults) == bool(s.label.any()) and name in generate.DOMAINS and math.isfinite(s.t[-1])
