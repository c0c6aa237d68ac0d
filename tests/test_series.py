"""Kernels over blocks against the same over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import dsp
from pulseframe.operators import features, series
from tests import kernels

KEYS = ["subject", "task"]
NAN = float("nan")


def frame(spark, named):
    data = [(s, t, i, None if v is None else float(v)) for (s, t), x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(data, "subject string, task string, idx long, value double")


def gathered(blocks, column="x"):
    """Series by name, put together."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.subject, r.task, r.block)):
        out.setdefault((r.subject, r.task), []).extend(r[column])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(3)
    long = np.cumsum(rng.normal(size=1650)) / 20
    holed = long.copy()
    holed[[0, 1, 40, 41, 42, 700, 1649]] = NAN
    holed[100:240] = np.inf
    return {("a", "long"): long, ("a", "holed"): holed, ("b", "short"): long[:20], ("b", "one"): long[:1], ("c", "none"): np.full(70, NAN), ("c", "steps"): np.round(long * 4) / 4, ("d", "flat"): np.zeros(200), ("d", "fall"): -np.arange(300.0), ("d", "mid"): long[:127]}


def test_blocks_and_halos(spark, walks):
    blocks = series.packed(frame(spark, walks), KEYS, 32)
    got = gathered(blocks)
    assert all(np.array_equal(got[k], x, equal_nan=True) for k, x in walks.items())
    assert {(r.block, len(r.x)) for r in blocks.where("subject = 'd' AND task = 'mid'").collect()} == {(0, 32), (1, 32), (2, 63)}
    for r in series.with_halo(blocks, KEYS, "x", 50, 7, 32).collect():
        x = walks[r.subject, r.task]
        stop = len(x) if r.block == r.last else r.start + 32
        assert r["from"] == max(0, r.start - 50) and np.array_equal(r.x, x[r["from"] : min(len(x), stop + 7)], equal_nan=True)


@pytest.mark.parametrize("step", [3, 37, 1000])
def test_blocks_of_numbers_with_gaps(spark, walks, step):
    """Numbers of a subject's rows of which a task has some only: blocks are as full as those of dense numbers."""
    got = series.packed(frame(spark, walks).withColumn("idx", F.col("idx") * step + F.col("idx") % 3), KEYS, 32)
    assert all(np.array_equal(gathered(got)[k], x, equal_nan=True) for k, x in walks.items())
    plain = lambda f: sorted((r.subject, r.task, r.block, r.start, len(r.x), r.n, r.last) for r in f.collect())
    assert plain(got) == plain(series.packed(frame(spark, walks), KEYS, 32))


def test_scr_features_of_numbers_with_gaps(spark):
    """Two tasks that take turns within a subject, each over several blocks."""
    x = np.round(np.cumsum(np.random.default_rng(6).normal(size=2600)), 3)
    turns = spark.createDataFrame([("T1", f"t{1 + i // 7 % 2}2", i, float(v)) for i, v in enumerate(x)], "subject string, task string, idx long, value double")
    for r in features.scr_features(turns, 5.0, size=400).collect():
        want = kernels.scr_row(x[np.arange(2600) // 7 % 2 == (r.task_id == "t22")], 5.0)
        for c in features.SCR_COLUMNS:
            assert near(r[c], want.get(c)), (r.task_id, c, r[c], want.get(c))


@pytest.mark.parametrize("size", [33, 64, 4096])
def test_filling_and_filters(spark, walks, size):
    blocks = series.filled(series.packed(frame(spark, walks), KEYS, size), KEYS)
    clean = series.detrended(blocks, KEYS)
    asked = [(3, (0.5, 5.0), 200.0), (2, (0.05,), 50.0, "high"), (4, (3.0,), 50.0, "low"), (1, (2.0,), 50.0, "low")]
    filters = [dsp.butterworth_sections(*f) for f in asked]
    flat, found = gathered(clean), [gathered(series.zero_phase(clean, KEYS, f, size)) for f in filters]
    filled = gathered(blocks)
    assert ("c", "none") not in filled
    for k, x in filled.items():
        want = dsp.fill_gaps(walks[k])
        assert np.allclose(x, want) and np.allclose(flat[k], dsp.detrend(want), atol=1e-9)
        for f, got in zip(filters, found):
            if len(x) > series.Filter(f).pad:
                assert np.abs(got[k] - dsp.zero_phase(f, dsp.detrend(want))).max() < 1e-9
            else:
                assert np.allclose(got[k], flat[k])


@pytest.mark.parametrize("size", [33, 50, 4096])
def test_peaks(spark, walks, size):
    known = {k: x for k, x in walks.items() if np.isfinite(x).all()}
    found = series.maxima(series.packed(frame(spark, known), KEYS, size), KEYS)
    for gap in (1, 5, 66):
        got = {}
        for r in series.thinned(found, KEYS, gap).collect():
            got.setdefault((r.subject, r.task), []).append((r.idx, r.prominence))
        for k, x in known.items():
            places, rise = dsp.peaks(x, gap, 0.0)
            assert sorted(got.get(k, [])) == list(zip(places.tolist(), rise.tolist()))


def test_rising_peaks(spark, monkeypatch):
    """Each peak higher than the one before and near it: one stays for certain, the others are thinned together."""
    monkeypatch.setattr(series, "PEAK_BLOCK", 64)
    x = np.arange(400.0)
    x[1::2] -= 3
    found = series.maxima(series.packed(frame(spark, {("a", "b"): x}), KEYS, 40), KEYS)
    assert sorted(r.idx for r in series.thinned(found, KEYS, 15).collect()) == dsp.peaks(x, 15, 0.0)[0].tolist()


@pytest.mark.parametrize("size", [300, 4096])
def test_spectra(spark, walks, size):
    known = {k: x - x.mean() for k, x in walks.items() if np.isfinite(x).all() and len(x) > 100}
    blocks = series.packed(frame(spark, known), KEYS, size)
    found = series.spectra(blocks, KEYS, 200.0, F.least(F.lit(256), F.col("n")), F.lit(2048), size, 0.1, 30.0).collect()
    for k, x in known.items():
        freq, power = dsp.welch(x, 200.0, 256, 2048)
        mine = sorted((r.bin, r.freq, r.power) for r in found if (r.subject, r.task) == k)
        inside = (freq >= 0.1) & (freq < 30.0)
        assert [b for b, _, _ in mine] == np.flatnonzero(inside).tolist() and np.allclose([f for _, f, _ in mine], freq[inside])
        assert np.allclose([p for _, _, p in mine], power[inside], rtol=1e-6, atol=1e-9 * power.max() + 1e-15)


def near(got, want):
    if isinstance(want, float) and got is not None:
        return got == pytest.approx(want, rel=1e-6, abs=1e-9)
    return got == want


@pytest.mark.parametrize("size", [700, 1 << 14])
def test_ecg_features(spark, size):
    rng = np.random.default_rng(4)
    t = np.arange(200 * 45) / 200
    beat = 0.5 * np.sin(2 * np.pi * 1.2 * t) + 0.05 * rng.normal(size=len(t))
    holed = beat.copy()
    holed[500:900] = NAN
    named = {("T1", "T12"): beat, ("T1", "T22"): np.full(2400, 0.1), ("T1", "T32"): np.zeros(500), ("T2", "T12"): holed, ("T2", "T22"): np.full(2100, NAN), ("T3", "T12"): 0.001 * np.sin(2 * np.pi * 0.06 * t[:2600])}
    for r in features.ecg_features(frame(spark, named), size=size).collect():
        want = kernels.ecg_row(named[r.user_id, r.task_id])
        for c in features.ECG_COLUMNS:
            assert near(r[c], want.get(c)), (r.user_id, r.task_id, c, r[c], want.get(c))


@pytest.mark.parametrize("size", [400, 1 << 14])
def test_scr_features(spark, size):
    rng = np.random.default_rng(5)
    rate = 50
    t = np.arange(rate * 90) / rate
    x = 5 + 0.01 * t + 0.002 * rng.normal(size=len(t))
    for at in (15, 40, 65):
        x = x + np.where(t >= at, (1 - np.exp(-(t - at) / 0.7)) * np.exp(-(t - at) / 3), 0)
    holed = x[:3000].copy()
    holed[700:760] = NAN
    named = {("T1", "t12"): x, ("T1", "t22"): holed, ("T2", "t12"): np.array([1.0, NAN, 3.0]), ("T2", "t22"): np.full(120, NAN), ("T3", "t12"): x[:130]}
    df = frame(spark, named)
    events = {}
    for r in features.scr_event_rows(df, size=size).collect():
        events.setdefault((r.user_id, r.task_id), []).append(r)
    for r in features.scr_features(df, size=size).collect():
        series_ = named[r.user_id, r.task_id]
        want = kernels.scr_row(series_, 50.0)
        for c in features.SCR_COLUMNS:
            assert near(r[c], want.get(c)), (r.user_id, r.task_id, c, r[c], want.get(c))
        mine = sorted(events.get((r.user_id, r.task_id), []), key=lambda e: e.peak_idx)
        assert [(e.onset_idx, e.peak_idx, e.recovery_idx) for e in mine] == [(e["onset_idx"], e["peak_idx"], e["recovery_idx"]) for e in kernels.scr_events(kernels.tonic_phasic(series_, 50.0)[1], 50.0)]


def test_eda_rows(spark):
    t = np.arange(50 * 60) / 50
    x = 5 + 0.02 * t + np.where(t >= 20, (1 - np.exp(-(t - 20) / 0.7)) * np.exp(-(t - 20) / 3), 0)
    named = {("T1", "T12"): x, ("T1", "T22"): np.array([1.0]), ("T2", "T12"): x[:12], ("T2", "T22"): np.full(20, NAN)}
    df = frame(spark, named)
    blocks, whole = features.eda_rows(df, size=256), features.eda_rows(df, kernel=kernels.eda_kernel)
    assert blocks.schema.simpleString() == whole.schema.simpleString()
    order = lambda f: sorted(f.collect(), key=lambda r: (r.subject, r.task, r.idx))
    for a, b in zip(order(blocks), order(whole), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:7], b[4:7], atol=1e-8) and a[7:] == b[7:]
