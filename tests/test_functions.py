import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import boxes, dsp, faces, labels, pose, times, values
from tests.helpers import rows

NAN, INF = float("nan"), float("inf")


def one(spark, column, **cells):
    names = ", ".join(f"{k} {t}" for k, (t, _) in cells.items())
    return spark.createDataFrame([tuple(v for _, v in cells.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize("x, finite", [(0.0, True), (-1e300, True), (NAN, False), (INF, False), (-INF, False), (None, False)])
def test_guards(spark, x, finite):
    cell = {"v": ("double", x)}
    assert one(spark, values.is_finite(F.col("v")), **cell) is finite
    assert one(spark, values.guarded(F.col("v") >= -INF, F.col("v")), **cell) is finite
    assert one(spark, values.finite(F.col("v")), **cell) == (x if finite else None)


@pytest.mark.parametrize("text, value", [(" 1.5 ", 1.5), ("", None), ("x", None), ("1_0", None), (None, None), ("-1", -1.0)])
def test_parsed(spark, text, value):
    assert one(spark, values.parsed(F.col("t")), t=("string", text)) == value


def test_range_with_margin(spark):
    r = one(spark, values.range_with_margin(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(3.0)), a=("int", 1))
    assert (round(r.low, 6), round(r.high, 6)) == (0.8, 3.2)


@pytest.mark.parametrize("raw, trigger, valid", [("T12", "t12", True), (" Anxitey ", "anxiety", True), ("terrify", "disgust", True), ("null", "none", False), ("drive", "none", False), ("base.", "base.", False), ("", "", False), (None, "none", False)])
def test_triggers(spark, raw, trigger, valid):
    cell = {"t": ("string", raw)}
    assert one(spark, labels.trigger(F.col("t")), **cell) == trigger
    assert one(spark, labels.is_valid_trigger(labels.trigger(F.col("t"))), **cell) is valid


@pytest.mark.parametrize("raw, target", [("T12", True), (" T22 ", True), ("t12", False), (None, False), ("T121", False)])
def test_targets(spark, raw, target):
    assert one(spark, labels.is_target(F.col("t")), t=("string", raw)) is target


def test_labels(spark):
    t = {"t": ("string", "T22")}
    assert [one(spark, labels.label(F.col("t"), m), **t) for m in labels.NAMES] == ["T22", "中", "medium", "medium_trust"]
    assert one(spark, labels.condition(F.col("t")), t=("string", "x")) == "unknown"
    assert one(spark, labels.scr_condition(F.col("t")), t=("string", "x")) == "x"
    with pytest.raises(ValueError):
        labels.label(F.lit("T12"), "fr")


def test_names(spark):
    path = {"p": ("string", "/data/t007/ECG/T007_ECG_T12_low_trust.csv")}
    got = [one(spark, f, **path) for f in (labels.stem(F.col("p")), labels.field(F.col("p"), 2), labels.field(F.col("p"), -1), labels.field(F.col("p"), 9), labels.path_subject(F.col("p")))]
    assert got == ["T007_ECG_T12_low_trust", "T12", "trust", None, "t007"]
    assert one(spark, labels.suffix_task(F.col("p")), p=("string", "a/bT22.JPG")) == "T22"
    assert one(spark, labels.suffix_task(F.col("p")), p=("string", "a/b.jpg")) == "UNKNOWN"
    assert [one(spark, labels.subject_order(F.col("p")), p=("string", x)) for x in ("T007", "12", "X9", None)] == [7, 12, 999, 999]
    assert one(spark, labels.subject_id(F.lit(7)), **path) == "T007"
    assert one(spark, labels.plot_trigger(F.col("p")), p=("string", "12_Sad_Movie_plot.PNG")) == "sad_movie"
    assert [one(spark, labels.safe_name(F.col("p")), p=("string", x)) for x in ("a b/ü-1", "/", None)] == ["abü-1", "unknown", "unknown"]


@pytest.mark.parametrize("text, us", [("24-05-01 10:00:00.5", 500_000), ("2024-05-01 10:00:00", 0), ("2024-05-01 10:00:00.123456", 123_456), ("24-5-1 1:0:0", None), ("", None), (None, None)])
def test_timestamps(spark, text, us):
    base = 1_714_557_600_000_000
    assert one(spark, times.micros(times.parse(F.col("t"))), t=("string", text)) == (None if us is None else base + us)


def test_milliseconds(spark):
    got = [one(spark, f(F.col("u")), u=("long", u)) for u in (1499, 1500, 1999) for f in (times.rounded_ms, times.truncated_ms)]
    assert got == [1000, 1000, 2000, 1000, 2000, 1000]
    assert one(spark, times.text_ms(F.col("u")), u=("long", 1_714_557_600_123_999)) == "2024-05-01 10:00:00.123"


def test_butterworth():
    b, a = dsp.butterworth(3, (0.5, 5.0), 200.0)
    assert np.allclose(b[:3], [3.081210415822e-4, 0, -9.243631247467e-4]) and len(b) == len(a) == 7 and np.allclose(a[-1], 0.7535348707)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * np.pi * f / 200)) / np.polyval(a, z))
    assert np.allclose([gain(0.5), gain(5.0), gain(math.sqrt(2.5))], [math.sqrt(0.5)] * 2 + [1.0], atol=1e-5)


@pytest.mark.parametrize("kind, passed, stopped", [("low", 0.01, 50.0), ("high", 50.0, 0.01)])
def test_butterworth_edges(kind, passed, stopped):
    b, a = dsp.butterworth(4, (3.0,), 200.0, kind)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * np.pi * f / 200)) / np.polyval(a, z))
    assert np.allclose([gain(3.0), gain(passed)], [math.sqrt(0.5), 1.0], atol=1e-4) and gain(stopped) < 1e-3


def test_zero_phase():
    sections = dsp.butterworth_sections(3, (0.5, 5.0), 200.0)
    assert np.abs(dsp.zero_phase(sections, np.ones(4000))).max() < 1e-9
    x = np.sin(2 * np.pi * 1.2 * np.arange(6000) / 200)
    assert np.corrcoef(x[1000:-1000], dsp.zero_phase(sections, x)[1000:-1000])[0, 1] > 0.999999
    with pytest.raises(ValueError):
        dsp.zero_phase(sections, np.ones(10))


@pytest.mark.parametrize("asked", [(3, (0.5, 5.0), 200.0), (2, (0.05,), 50.0, "high"), (4, (3.0,), 50.0, "low"), (1, (2.0,), 50.0, "low"), (3, (2.0,), 50.0, "high")])
def test_sections(asked):
    """Sections multiply to the whole filter."""
    top, bottom = np.ones(1), np.ones(1)
    for b0, b1, b2, a1, a2 in dsp.butterworth_sections(*asked):
        top, bottom = np.convolve(top, [b0, b1, b2]), np.convolve(bottom, [1, a1, a2])
    b, a = dsp.butterworth(*asked)
    assert np.allclose(top[: len(b)], b, atol=1e-15) and np.allclose(bottom[: len(a)], a) and not top[len(b) :].any() and not bottom[len(a) :].any()


def test_savitzky_golay():
    t = np.arange(300.0)
    cubic = 1e-5 * t**3 - t
    assert np.allclose(dsp.savitzky_golay(cubic, 101, 3), cubic)
    kernel = np.zeros(11)
    kernel[5] = 35
    assert np.allclose(dsp.savitzky_golay(kernel, 5, 2)[3:8], [-3, 12, 17, 12, -3])


def test_peaks():
    assert [x.tolist() for x in dsp.peaks(np.array([0, 3, 1, 2, 0.0]), 1, 0)] == [[1, 3], [3.0, 1.0]]
    assert dsp.peaks(np.array([0, 1, 2, 2, 2, 1, 0.0]), 1, 0)[0].tolist() == [3]
    assert dsp.peaks(np.array([0, 3, 1, 2, 0.0]), 3, 0)[0].tolist() == [1]
    assert dsp.peaks(np.array([0, 3, 1, 2, 0.0]), 1, 2)[0].tolist() == [1]
    x = np.sin(2 * np.pi * 1.2 * np.arange(6000) / 200)
    assert len(dsp.peaks(x, 66, 0.5)[0]) == 36


def test_welch():
    rng = np.random.default_rng(0)
    f, p = dsp.welch(rng.normal(size=20_000), 200, 1024, 32768)
    assert abs(np.trapezoid(p, f) - 1) < 0.1
    f, p = dsp.welch(np.sin(2 * np.pi * 1.2 * np.arange(12_000) / 200), 200, 1024, 16384)
    assert abs(f[p.argmax()] - 1.2) < 0.02 and abs(np.trapezoid(p, f) - 0.5) < 0.01


def test_gaps_and_detrend():
    assert dsp.fill_gaps(np.array([NAN, 1, NAN, 3, INF])).tolist() == [1, 1, 2, 3, 3]
    assert dsp.fill_gaps(np.array([NAN, INF])) is None
    assert np.abs(dsp.detrend(np.arange(50.0) * 3 + 2)).max() < 1e-9


def face_frame(spark, points, w=640, h=480):
    schema = "landmarks array<struct<x: double, y: double, z: double>>, width int, height int"
    return spark.createDataFrame([(points, w, h)], schema)


@pytest.mark.parametrize("profile", faces.PROFILES)
def test_face_measures(spark, profile):
    rng = np.random.default_rng(3)
    points = rng.random((478, 3))
    face = faces.Face(F.col("landmarks"), F.col("width"), F.col("height"), profile)
    measures = faces.ear(face) | faces.face3d(face) | faces.action_units(face)
    assert len(measures) == 3 + 18 + 22
    got = face_frame(spark, [tuple(map(float, p)) for p in points]).select(*[c.alias(k) for k, c in measures.items()]).first()
    px = points[:, :2] * (640, 480)
    gap = lambda a, b: np.linalg.norm(px[a] - px[b])
    unit = np.linalg.norm(px[[362, 263]].mean(0) - px[[133, 33]].mean(0))
    right = (gap(159, 144) + gap(160, 145)) / (2 * gap(133, 33))
    nose = {"combined": (98, 327), "per_subject": (94, 334)}[profile]
    eye = px[list(faces.PROFILES[profile]["left_eye"])]
    assert got.ear_right == pytest.approx(right) and got.au9_nose_wrinkle == pytest.approx(gap(*nose) / unit)
    assert got.face3d_left_eye_h == pytest.approx(np.ptp(eye[:, 1]) / unit) and got.face3d_nose_depth == pytest.approx(points[4, 2])
    assert got.au20_lip_stretch == pytest.approx(gap(61, 291) / gap(172, 397)) and got.au4_brow_lower_l == pytest.approx(np.linalg.norm(px[[362, 263]].mean(0) - px[296]) / unit)


def test_face_without_extent(spark):
    face = faces.Face(F.col("landmarks"), F.col("width"), F.col("height"))
    got = face_frame(spark, [(0.5, 0.5, 0.0)] * 478).select(*[c.alias(k) for k, c in (faces.ear(face) | faces.face3d(face)).items()]).first()
    assert math.isnan(got.ear_right) and math.isnan(got.ear_avg) and got.face3d_inter_eye_dist_norm == 1.0


def test_head_pose(spark):
    model = np.array(list(pose.MODEL.values()))
    turned = pose.rotation(np.array([math.pi, 0, 0])) @ pose.rotation(np.array([0.1, 0.25, -0.15]))
    seen = model @ turned.T + (20, -10, 600)
    px = 640 * seen[:, :2] / seen[:, 2:] + (320, 240)
    points = [(0.0, 0.0, 0.0)] * 478
    for i, p in zip((faces.POINTS[k] for k in pose.MODEL), px):
        points[i] = (float(p[0] / 640), float(p[1] / 480), 0.0)
    got = face_frame(spark, points).select(pose.head_pose(F.col("landmarks"), F.col("width"), F.col("height")).alias("p")).first().p
    assert np.allclose(tuple(got), pose.angles(turned), atol=1e-3)
    none = face_frame(spark, None).select(pose.head_pose(F.col("landmarks"), F.col("width"), F.col("height")).alias("p")).first().p
    assert none is None or none.yaw_deg is None or math.isnan(none.yaw_deg)


def boxed(spark, found, w=1280, h=720):
    df = spark.createDataFrame([(found, w, h)], "faces array<struct<x: double, y: double, w: double, h: double>>, w int, h int")
    return tuple(boxes.with_crop_box(df, F.col("faces"), F.col("w"), F.col("h")).first().box)


def test_boxes(spark):
    assert boxed(spark, []) == (282, 58, 998, 720, "fallback_complete_visible_face")
    assert boxed(spark, [(0.0, 0.0, 100.0, 100.0)])[4] == "fallback_complete_visible_face"
    assert boxed(spark, [(540.0, 200.0, 200.0, 200.0)]) == (365, 50, 915, 720, "opencv_haar")
    # of two equal scores the first counts; a better one wins
    assert boxed(spark, [(540.0, 200.0, 100.0, 100.0), (540.0, 200.0, 200.0, 200.0)]) == boxed(spark, [(540.0, 200.0, 200.0, 200.0)])


def test_helpers_order(spark):
    assert rows(spark.createDataFrame([(2.0, "b"), (None, "a")], "x double, y string")) == [(2.0, "b"), (None, "a")]


def test_peaks_equal_plain_definition():
    import numpy as np

    from pulseframe.functions import dsp

    def plain(x, gap, least):
        places = [(i + j) // 2 for i in range(1, len(x)) for j in range(i, len(x) - 1) if x[i] > x[i - 1] and all(x[k] == x[i] for k in range(i, j + 1)) and x[j + 1] < x[i]]
        keep = dict.fromkeys(places, True)
        for p in sorted(places, key=lambda p: (x[p], p), reverse=True):
            if keep[p]:
                keep |= {q: False for q in places if q != p and abs(q - p) < gap}
        out = []
        for p in (p for p in places if keep[p]):
            left = next((k for k in range(p, -1, -1) if x[k] > x[p]), -1)
            right = next((k for k in range(p, len(x)) if x[k] > x[p]), len(x))
            rise = x[p] - max(min(x[left + 1 : p + 1]), min(x[p:right]))
            if rise >= least:
                out.append((p, rise))
        return out

    rng = np.random.default_rng(3)
    for n in range(30):
        x = rng.integers(0, 8, 60).astype(float) if n % 2 else rng.normal(size=60)
        found, rise = dsp.peaks(x, 1 + n % 7, 0.5)
        assert list(zip(found.tolist(), rise.tolist())) == plain(x.tolist(), 1 + n % 7, 0.5)
    wave = np.sin(np.arange(720_000) / 30) + rng.normal(0, 0.1, 720_000)
    assert len(dsp.peaks(wave, 60, 0.5)[0]) > 3000
