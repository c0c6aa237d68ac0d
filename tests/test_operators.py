import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import anomalies, expand, face, features, ordered, quality, resample, stats
from tests.helpers import rows

NAN, INF = float("nan"), float("inf")


def signal(spark, values, subject="T001", tasks=None):
    tasks = tasks or ["T12"] * len(values)
    return spark.createDataFrame([(subject, i, t, v) for i, (v, t) in enumerate(zip(values, tasks))], "subject string, idx long, task string, value double")


def test_ordered_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(f"s{rng.integers(2)}", int(i), float(rng.integers(9))) for i in rng.permutation(400)]
    df = spark.createDataFrame(data, "k string, o long, v double")
    numbered = ordered.number_rows(df, ["k"], ["o"], F.expr("o div 16"))
    want = []
    for k in ("s0", "s1"):
        mine = sorted((o, v) for kk, o, v in data if kk == k)
        want += [(k, o, i, mine[i - 1][1] if i else None) for i, (o, v) in enumerate(mine)]
    assert rows(ordered.with_previous(numbered, ["k"], "idx", {"p": "v"}, block=7), "k", "o", "idx", "p") == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_and_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, 300, 40))  # with repeated times
    raw = spark.createDataFrame([("a", int(x), i, float(rng.normal()), f"l{i}") for i, x in enumerate(t)], "k string, t long, seq long, value double, trigger string")
    held = raw.orderBy("seq").collect()
    grid = resample.grid(raw, ["k"], 7)
    at = np.arange(t[0], t[-1] + 1, 7)
    assert [r.t for r in grid.orderBy("i").collect()] == at.tolist()
    got = resample.interpolated(grid, raw, ["k"], "value", 32).orderBy("i").collect()
    assert np.allclose([r.value for r in got], np.interp(at, t, [r.value for r in held]))
    place = np.minimum(np.searchsorted(t, at, "left"), len(t) - 1)
    got = resample.next_label(grid, raw, ["k"], "trigger", 32).orderBy("i").collect()
    assert [r.trigger for r in got] == [held[p].trigger for p in place]


def test_next_label_behind_the_last_row(spark):
    raw = spark.createDataFrame([("a", 10, 0, "x"), ("a", 20, 1, "y")], "k string, t long, seq long, trigger string")
    points = spark.createDataFrame([("a", 0, 5), ("a", 1, 20), ("a", 2, 25)], "k string, i long, t long")
    assert rows(resample.next_label(points, raw, ["k"], "trigger", 8), "i", "trigger") == [(0, "x"), (1, "y"), (2, "y")]


def test_segment_resample(spark):
    raw = [("a", 0, 0, 1.0), ("a", 10, 1, 2.0), ("a", 10, 2, 9.0), ("a", 30, 3, 4.0), ("b", 5, 0, 1.0), ("c", 5, 0, 1.0), ("c", 5, 1, 2.0)]
    df = spark.createDataFrame(raw, "k string, t long, seq long, value double")
    assert rows(resample.segment_resample(df, ["k"], 10), "k", "i", "t", "value") == [("a", 0, 0, 1.0), ("a", 1, 10, 2.0), ("a", 2, 20, 3.0), ("a", 3, 30, 4.0)]


@pytest.mark.parametrize("triggers, want", [
    ("A,none,A", [(1, "A", 0, 2, 2)]), ("A,B,A", [(1, "A", 0, 0, 1), (2, "B", 1, 1, 1), (3, "A", 2, 2, 1)]), ("none,base.,", []), ("none,A,A,B", [(1, "A", 1, 2, 2), (2, "B", 3, 3, 1)]),
])
def test_islands(spark, triggers, want):
    df = spark.createDataFrame([("s", i, i, x) for i, x in enumerate(triggers.split(","))], "k string, t long, seq long, trigger string")
    found = resample.islands(df, ["k"], block_us=2)
    assert rows(found, "segment", "trigger", "start_t", "end_t", "n_rows") == want
    again = resample.last_of_trigger(found, ["k"])
    assert {r.segment for r in again.collect()} == {max(s for s, t, *_ in want if t == x) for x in {t for _, t, *_ in want}}


def test_reslice(spark):
    samples = spark.createDataFrame([("s", i) for i in range(20)], "k string, t long")
    segments = spark.createDataFrame([("s", 1, "A", 3, 9), ("s", 2, "B", 12, 13)], "k string, segment long, trigger string, start_t long, end_t long")
    assert rows(resample.reslice(segments, samples, ["k"], 3, 4), "segment", "t") == [(1, i) for i in range(3, 10)]
    assert resample.reslice(segments, samples, ["k"], 1, 4).count() == 9
    assert resample.least_samples(50) == 100 and resample.least_samples(2) == 10


def test_quantiles_count_few_values(spark):
    """Of many different values only those near the wanted ranks are told apart, whatever their scale."""
    rng = np.random.default_rng(12)
    drawn = {"wide": rng.lognormal(0, 30, 3001) * rng.choice([-1, 1], 3001), "close": 37 + rng.random(3000) / 1000, "ends": np.array([-INF, -0.0, 0.0, INF, INF]), "same": np.full(2000, 0.1), "price": np.round(rng.uniform(900, 105_000, 3000), 2), "one": np.array([5e-324])}
    df = spark.createDataFrame([(k, float(v)) for k, x in drawn.items() for v in [*x, NAN]], "k string, v double")
    asked = {"low": 0.01, "med": 0.5, "high": 0.99}
    for r in stats.quantiles(df, ["k"], "v", asked, 200).collect():
        x = np.sort(drawn[r.k])
        for name, q in asked.items():
            at = (len(x) - 1) * q
            a, b, share = float(x[math.floor(at)]), float(x[math.ceil(at)]), at - math.floor(at)
            assert r.n == len(x) and r[name] == (a if a == b or not share else pytest.approx(a * (1 - share) + b * share, rel=1e-9)), (r.k, name)
    counts = {r.k: r["count"] for r in stats.narrowed(df, ["k"], "v", asked, 200).groupBy("k").count().collect()}
    assert counts["wide"] < 100 and counts["price"] < 400 and counts["close"] < 100


def test_reslice_tries_no_pairs(spark):
    """Segments of random runs, many of which meet in one time, over blocks of any length; joins compare no times."""
    draw = random.Random(5)
    data = [(k, draw.randrange(60), i, draw.choice("AB C".split() + ["none"])) for k in "xyz" for i in range(120)]
    raw = spark.createDataFrame(data, "k string, t long, seq long, trigger string")
    for block in (7, 1000):
        segments = resample.islands(raw, ["k"], block_us=block)
        spans = [(r.k, r.segment, r.trigger, r.start_t, r.end_t) for r in segments.collect()]
        for least in (1, 4):
            met = [(k, s, x, seq) for k, s, x, a, b in spans for own, t, seq, _ in data if own == k and a <= t <= b]
            sizes = Counter((k, s) for k, s, _, _ in met)
            found = resample.reslice(segments, raw.select("k", "t", "seq"), ["k"], least, block)
            assert rows(found, "k", "segment", "segment_trigger", "seq") == sorted(m for m in met if sizes[m[:2]] >= least)
            joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
            assert joins and not any("start_t" in line for line in joins)


def test_uniform_resample(spark):
    raw = spark.createDataFrame([("s", 0, 0, 1.0, "a"), ("s", 50, 1, None, "x"), ("s", 40, 2, 3.0, "b")], "k string, t long, seq long, value double, trigger string")
    assert rows(resample.uniform_resample(raw, ["k"], 20, 16), "i", "value", "trigger") == [(0, 1.0, "a"), (1, 2.0, "b"), (2, 3.0, "b")]


def test_fixed_rates(spark):
    raw = spark.createDataFrame([("s", 0, 1_000_000, [1.0, 2.0, 9.0], "x"), ("s", 1, 5, [3.0, 4.0, 9.0], " T12 "), ("s", 2, 7, [], "T22")], "k string, o long, t long, e array<double>, trigger string")
    assert rows(expand.expand_rows(raw, ["k"], "o", "t", "e", step_us=10, width=2), "sample_idx", "t", "value", "trigger") == [(2, 1_000_020, 3.0, "T12"), (3, 1_000_030, 4.0, "T12")]
    assert rows(expand.restamp_rows(raw.withColumn("v", F.lit(1.0)), ["k"], "o", "t", "v", step_us=10), "sample_idx", "t") == [(1, 1_000_010), (2, 1_000_020)]
    assert rows(raw.select("o", expand.channel_mean(F.col("e"), 2))) == [(0, 1.5), (1, 3.5), (2, None)]
    assert rows(spark.createDataFrame([(0.0,), (2.0,), (-4.0,)], "r double").select(expand.conductance(F.col("r")))) == [(-250.0,), (500.0,), (pytest.approx(1e12),)]


def test_sampling_rate(spark):
    df = spark.createDataFrame([("a", 20_000, 0), ("a", 40_000, 20_000), ("a", 40_000, 40_000), ("b", 5, None)], "k string, t long, p long")
    assert rows(expand.sampling_rate(df, ["k"], "t", "p")) == [("a", 50.0), ("b", 50.0)]
    assert rows(expand.sampling_rate(df, ["k"], "t", "p", None)) == [("a", 50.0), ("b", None)]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"a": np.round(rng.lognormal(0, 3, 501), 2), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0], [3, 4])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "k string, v double")
    asked = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in stats.quantiles(df, ["k"], "v", asked).collect():
        assert r.n == len(groups[r.k]) and np.allclose([r[x] for x in asked], np.percentile(groups[r.k], [100 * q for q in asked.values()]))
    for r in stats.median_and_mad(df, ["k"], "v").collect():
        med = np.median(groups[r.k])
        assert np.allclose([r.med, r.mad], [med, np.median(np.abs(groups[r.k] - med))])


@pytest.mark.parametrize("largest", [4, 16])
def test_quantiles_of_extreme_values(spark, largest):
    """Infinities, the largest and smallest doubles, both zeros: parts shrink by their bits, so it ends."""
    rng = np.random.default_rng(largest)
    values = np.concatenate((rng.normal(size=80), [INF, -INF, 1e308, -1e308, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1e-308, 1.0 + 2**-52, 1.0], np.full(30, 2.5)))
    df = spark.createDataFrame([("a", float(x)) for x in values] + [("a", NAN), ("b", INF), ("b", INF), ("c", -1.7e308), ("c", 1.7e308)], "k string, v double")
    asked = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in stats.quantiles(df, ["k"], "v", asked, largest=largest).collect()}
    ordered_ = np.sort(values)
    for name, q in asked.items():
        at = q * (len(values) - 1)
        low, high = ordered_[math.floor(at)], ordered_[math.ceil(at)]
        want = low if low == high or at == math.floor(at) else low * (1 - at % 1) + high * (at % 1)
        assert got["a"][name] == pytest.approx(want)
    assert got["a"].n == len(values) and got["b"].p50 == INF and got["c"].p50 == 0.0 and got["c"].p25 == pytest.approx(-0.85e308)


def test_modes(spark):
    df = spark.createDataFrame([("a", 2.0, 0), ("a", 1.0, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("a", None, 4)], "k string, v double, i long")
    assert rows(stats.modes(df, ["k"], "v", "i")) == [("a", 2.0, 0.5)]


def test_histogram(spark):
    x = np.random.default_rng(0).normal(size=500)
    got = stats.histogram(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 30).orderBy("bin").collect()
    counts, edges = np.histogram(x, 30)
    assert [r.n for r in got] == counts.tolist() and np.allclose([r.low for r in got], edges[:-1])
    same = stats.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in same] == np.histogram([2.0] * 3, 4)[0].tolist()


def test_five_numbers(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", NAN, 7.0), ("a", 4.0, None), ("b", NAN, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in stats.five_numbers(df, ["k"], ["x", "y"]).collect()}
    assert (got["a"].rows, got["a"].x_mean, got["a"].x_median, got["a"].x_min, got["a"].x_max) == (3, 2.5, 2.5, 1.0, 4.0)
    assert got["a"].x_std == pytest.approx(np.std([1, 4], ddof=1)) and got["b"].x_mean is None and got["b"].x_median is None and got["b"].y_std is None


def gsr_by_hand(x):
    out = [set() for _ in x]
    fine = np.isfinite(x)
    with np.errstate(invalid="ignore"):
        step = np.diff(x)
    valid = fine & (x > 1) & (x < 1000)
    med = np.median(x[valid]) if valid.sum() >= 20 else 0.0
    mad = np.median(np.abs(x[valid] - med)) if valid.sum() >= 20 else 0.0
    for i, v in enumerate(x):
        for name, held in (("non_finite", not fine[i]), ("non_positive_le_0", fine[i] and v <= 0), ("sentinel_value_1", v == 1), ("high_resistance_ge_1000", fine[i] and v >= 1000), ("large_step_ge_500", i > 0 and np.isfinite(step[i - 1]) and abs(step[i - 1]) >= 500), ("robust_outlier_mad_gt_8", valid[i] and mad > 0 and 0.6745 * abs(v - med) / mad > 8)):
            if held:
                out[i].add(name)
    return out


def test_gsr_rules(spark):
    edge = [0.0, -1.0, 0.5, 1.0, 1.0000001, 999.999, 1000.0, 500.0, 1000.0, NAN, INF, 900.0, -INF, 300.0]
    for extra in (0, 19, 40):
        x = np.array(edge + list(np.random.default_rng(extra).normal(50, 2, extra)))
        points = anomalies.gsr_points(signal(spark, [float(v) for v in x]))
        got = {r.idx: set(r.reasons) for r in points.collect()}
        want = gsr_by_hand(x)
        assert got == dict(enumerate(want))
    r = anomalies.gsr_summary(points).first()
    fine = x[np.isfinite(x)]
    assert r.Rows == len(x) and r.AnomalyRows == sum(map(bool, want)) and r.ZeroOrOneFraction == pytest.approx((fine <= 1).sum() / len(x))
    assert np.allclose([r.Min, r.P01, r.Median, r.P99, r.Max], np.percentile(fine, [0, 1, 50, 99, 100])) and r.Flags == "many_zero_or_one"
    assert r.NonPositiveRows == 2 and r.ParseErrors == 0


def test_no_finite_value_and_errors(spark):
    points = anomalies.gsr_points(signal(spark, [NAN, INF]))
    errors = spark.createDataFrame([("T001", 7, "bad value: x")], "subject string, row long, reason string")
    r = anomalies.gsr_summary(points, errors).first()
    assert (r.Rows, r.AnomalyRows, r.Median, r.ModeFraction, r.ZeroOrOneFraction, r.ParseErrors, r.Flags) == (2, 2, None, None, 0.0, 1, "")
    assert rows(anomalies.point_rows(points, errors), "row", "reasons") == [(0, "non_finite"), (1, "non_finite"), (7, "bad value: x")]
    assert anomalies.gsr_summary(anomalies.gsr_points(signal(spark, [1.0]).where("false"))).count() == 0


def ecg_by_hand(x, window=400):
    out = [set() for _ in x]
    fine = np.isfinite(x)
    for a in range(0, len(x) - window + 1, window // 2):
        part = x[a : a + window]
        part = part[np.isfinite(part)]
        if len(part) >= 2 and part.std() < 1e-6:
            for i in range(a, a + window):
                if fine[i]:
                    out[i].add("flatline_window")
    with np.errstate(invalid="ignore"):
        step = np.diff(x)
    valid = fine & (np.abs(x) <= 2)
    med = np.median(x[valid]) if valid.sum() >= 20 else 0.0
    mad = np.median(np.abs(x[valid] - med)) if valid.sum() >= 20 else 0.0
    for i, v in enumerate(x):
        for name, held in (("non_finite", not fine[i]), ("extreme_amplitude_gt_2", fine[i] and abs(v) > 2), ("large_step_gt_1", i > 0 and np.isfinite(step[i - 1]) and abs(step[i - 1]) > 1), ("robust_outlier_mad_gt_8", valid[i] and mad > 0 and 0.6745 * abs(v - med) / mad > 8)):
            if held:
                out[i].add(name)
    return out


@pytest.mark.parametrize("n", [1, 399, 400, 599, 600, 1750])
def test_ecg_rules(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.2, n)
    x[min(50, n - 1) : 1100] = 0.25
    x[::97] = NAN
    x[3::211], x[5::307] = 2.0, 2.0000001
    if n > 1200:
        x[1111], x[1130] = INF, 1.9
    points = anomalies.ecg_points(signal(spark, [float(v) for v in x], tasks=["T12" if i < n // 2 else "T22" for i in range(n)]))
    got = points.orderBy("idx").collect()
    want = ecg_by_hand(x)
    assert [set(r.reasons) for r in got] == want
    if n == 1750:
        r = anomalies.ecg_summary(points).first()
        serious = [w & set(anomalies.SERIOUS) for w in want]
        assert (r.AllAnomalyPoints, r.SeriousAnomalyPoints, r.AnomalyRows) == (sum(map(len, want)), sum(map(len, serious)), sum(map(bool, want)))
        assert r.T12_SeriousFrac == pytest.approx(sum(map(bool, serious[:875])) / 875) and r.T22_AllFrac == pytest.approx(sum(map(bool, want[875:])) / 875) and r.T32_AllFrac is None


def test_steps_at_the_border_of_tasks(spark):
    s = signal(spark, [0.0, 1.5, 0.0, 0.0], tasks=["T12", "T22", "T22", "T22"])
    got = lambda **k: [r.idx for r in anomalies.ecg_points(s, **k).where(F.array_contains("reasons", "large_step_gt_1")).orderBy("idx").collect()]
    assert got() == [1, 2] and got(per_task=True) == [2]


FEATURE = {"condition": "", "n_samples": 20_000, "duration_sec": 100.0, "ecg_mean": 0.0, "ecg_std": 0.5, "ecg_min": 0.0, "ecg_max": 1.0, "n_peaks": 100, "peak_rate_per_min": 60.0, "mean_ibi_ms": 1.0, "cv_ibi_pct": 1.0, "lf_hf_ratio": 1.0, "dominant_freq_hz": 1.0, "quality_flags": ""}
FEATURE_SCHEMA = "user_id string, task_id string, file string, condition string, n_samples long, duration_sec double, ecg_mean double, ecg_std double, ecg_min double, ecg_max double, n_peaks int, peak_rate_per_min double, mean_ibi_ms double, cv_ibi_pct double, lf_hf_ratio double, dominant_freq_hz double, quality_flags string"
SUMMARY_SCHEMA = "Subject string, SeriousAnomalyFraction double, AllAnomalyFraction double, T12_SeriousFrac double, T22_SeriousFrac double, T32_SeriousFrac double, T12_AllFrac double, T22_AllFrac double, T32_AllFrac double, Flags string"


def graded(spark, feature=None, serious=0.0, whole=0.0, own_serious=None, own_all=None, **options):
    f = [("T001", t, f"f{t}", *(FEATURE | (feature or {} if t == "T12" else {})).values()) for t in ("T12", "T22")]
    summary = [("T001", serious, whole, own_serious, None, None, own_all, None, None, "")]
    got = quality.grade(spark.createDataFrame(f, FEATURE_SCHEMA), spark.createDataFrame(summary, SUMMARY_SCHEMA), **options)
    return {r.task_id: (r.recommendation, r.reasons) for r in got.collect()}


@pytest.mark.parametrize("change, want", [
    ({}, ("keep", "")), ({"feature": {"duration_sec": 60.0}}, ("keep", "")), ({"feature": {"duration_sec": 59.99}}, ("review", "short_duration_(<60s)")), ({"feature": {"ecg_std": 1.0000001}}, ("review", "high_variation")),
    ({"feature": {"peak_rate_per_min": 29.0}}, ("review", "abnormal_peak_rate")), ({"feature": {"peak_rate_per_min": 30.0}}, ("keep", "")), ({"feature": {"peak_rate_per_min": 201.0}}, ("review", "abnormal_peak_rate")),
    ({"feature": {"n_peaks": 0, "peak_rate_per_min": 5.0}}, ("keep", "")), ({"feature": {"peak_rate_per_min": NAN, "ecg_std": NAN}}, ("keep", "")),
    ({"feature": {"quality_flags": "too_short;too_few_peaks", "duration_sec": 5.0}}, ("drop", "too_short_duration;too_few_peaks;short_duration_(<60s)")),
    ({"serious": 0.01}, ("drop", "high_serious_anomaly_fraction_(>=1%)")), ({"serious": 0.0099999}, ("review", "elevated_serious_anomaly_fraction_(>=0.1%)")), ({"serious": 0.001}, ("review", "elevated_serious_anomaly_fraction_(>=0.1%)")),
    ({"whole": 0.1}, ("drop", "high_all_anomaly_fraction_(>=10%)")), ({"whole": 0.02}, ("review", "elevated_all_anomaly_fraction_(>=2%)")), ({"serious": 0.5, "own_serious": 0.0005}, ("keep", "")),
    ({"serious": 0.5, "own_serious": 0.0}, ("drop", "high_serious_anomaly_fraction_(>=1%)")), ({"serious": 0.5, "own_serious": 0.0, "strict": True}, ("keep", "")), ({"serious": NAN}, ("keep", "")),
])
def test_grades(spark, change, want):
    found = graded(spark, **change)
    assert found["T12"] == want and found["T32"] == ("drop", "missing_feature_row")


def test_status_and_reasons(spark):
    g = spark.createDataFrame([("T1", t, r, x) for t, r, x in (("T12", "drop", "a;b"), ("T22", "drop", "a"), ("T32", "keep", ""))] + [("T2", "T12", "review", "b")] + [("T3", "T12", "keep", "")], "user_id string, task_id string, recommendation string, reasons string")
    assert rows(quality.subject_status(g), "user_id", "status") == [("T1", "drop"), ("T2", "review"), ("T3", "ok")]
    assert rows(quality.reason_histogram(g)) == [("a", 2), ("b", 2)] and rows(quality.reason_histogram(g, "review")) == [("b", 1)]


def test_first_row_and_combined_files(spark):
    df = spark.createDataFrame([("T1", "T12", "T1_ECG_T12_low.csv", 1), ("T1", "T12", "T1_ECG_T12_T22_T32_processed.csv", 2)], "u string, t string, file string, v int")
    assert rows(quality.first_rows(df, ["u", "t"], ["file"]), "v") == [(2,)] and rows(quality.without_combined(df), "v") == [(1,)]


@pytest.mark.parametrize("n", [1, 14, 15, 16, 30, 101])
def test_evenly_spaced(spark, n):
    df = spark.createDataFrame([("g", f"{i:04d}") for i in range(n)], "g string, p string")
    want = range(n) if n <= 15 else np.linspace(0, n - 1, 15, dtype=int)
    assert [int(p) for _, p in rows(quality.evenly_spaced(df, ["g"], "p"))] == sorted(set(want))


def test_ecg_features(spark):
    t = np.arange(200 * 90) / 200
    beat = 0.5 * np.sin(2 * np.pi * 1.2 * t)
    flat, short = np.full(200 * 70, 0.1), np.zeros(500)
    data = [("T001", task, i, float(v)) for task, x in (("T12", beat), ("T22", flat), ("T32", short)) for i, v in enumerate(x)]
    got = {r.task_id: r for r in features.ecg_features(spark.createDataFrame(data, "subject string, task string, idx long, value double")).collect()}
    r = got["T12"]
    assert r.condition == "low_trust" and abs(r.peak_rate_per_min - 72) < 0.5 and abs(r.dominant_freq_hz - 1.2) < 0.05 and r.lf_power > r.hf_power and r.quality_flags == ""
    assert r.n_peaks in (107, 108, 109) and r.cv_ibi_pct < 1 and 0 <= r.spectral_entropy < 0.8
    assert got["T22"].quality_flags == "flatline_signal;too_few_peaks" and got["T22"].n_peaks == 0 and got["T32"].quality_flags == "too_short" and got["T32"].lf_power is None


def test_scr_features(spark):
    rate, n = 50, 50 * 90
    t = np.arange(n) / rate
    x = 5 + 0.01 * t
    for at in (15, 40, 65):
        x = x + np.where(t >= at, (1 - np.exp(-(t - at) / 0.7)) * np.exp(-(t - at) / 3), 0)
    data = spark.createDataFrame([("T001", "t12", i, float(v)) for i, v in enumerate(x)], "subject string, task string, idx long, value double")
    r = features.scr_features(data).first()
    assert r.scr_count >= 3 and (r.condition, r.quality_flags, r.n_samples, r.duration_sec) == ("low_trust", "", n, 90.0)
    events = sorted(features.scr_event_rows(data).collect(), key=lambda e: e.peak_idx)
    large = [e for e in events if e.amplitude > 0.3]
    assert len(events) == r.scr_count and [round(e.peak_idx / rate) for e in large] == [16, 41, 66]
    assert all(e.onset_idx < e.peak_idx < e.recovery_idx and e.rise_time_sec <= 4 for e in large)
    assert r.scr_amp_sum == pytest.approx(sum(e.amplitude for e in events)) and r.scr_amp_max == max(e.amplitude for e in events)


def test_face_features_and_summary(spark):
    rng = np.random.default_rng(5)
    points = [[tuple(map(float, p)) for p in rng.random((478, 3))] for _ in range(3)]
    data = [("/x/T001_a_T12.jpg", 64, 48, points[0], None), ("/x/T001_b_T12.jpg", 64, 48, points[1], None), ("/x/T001_c_t22.jpg", 64, 48, points[2], None), ("/x/T002_d_T12.jpg", 64, 48, None, None), ("/x/T002_e_T12.jpg", 64, 48, points[0][:5], None)]
    found = face.features(spark.createDataFrame(data, "path string, width int, height int, landmarks array<struct<x: double, y: double, z: double>>, error string"), "per_subject").cache()
    assert rows(found.where("error IS NOT NULL"), "image_name", "error") == [("T002_d_T12.jpg", "no_face"), ("T002_e_T12.jpg", "too few landmarks")]
    assert rows(face.summary(found), "subject_id", "task_id", "condition", "image_count") == [("T001", "T12", "low_trust", 2), ("T001", "T22", "medium_trust", 1)]
    assert len(face.summary(found).columns) == 4 + 43 * 5
    both = [r.ear_avg for r in found.where("task_id = 'T12' AND error IS NULL").collect()]
    r = face.summary(found).where("task_id = 'T12'").first()
    assert r.ear_avg_mean == pytest.approx(sum(both) / 2) and r.ear_avg_median == pytest.approx(sum(both) / 2) and not math.isnan(r.ear_avg_std)
