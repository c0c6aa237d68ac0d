import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import jpeg
from pulseframe.operators import quality
from pulseframe.plans import flows
from pulseframe.sources import images, mat, recordings, sinks, tables
from tests.helpers import rows

HEAD = ",".join(["Timestamp", *recordings.CHANNELS, "Trigger"])


def ecg_line(second, values, trigger):
    return ",".join([f"24-05-01 10:00:{second:06.3f}", *map(str, values), trigger])


def put(path, *lines, bom=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    put(root / "T001/ECG/a.csv", HEAD, *[ecg_line(i / 4, [i + c / 100 for c in range(50)], "T12" if i else "null") for i in range(60)])
    put(root / "T001/ECG/b.csv", HEAD, *[ecg_line(15 + i / 4, ["x" if i == 3 else 1.0] * 50, "T22") for i in range(8)])
    put(root / "T001/GSR/a.csv", "Timestamp,Resistance(Koum),Trigger", *[f"24-05-01 10:00:{i / 50:06.3f},{100 + i % 7},{'T12' if i < 150 else 'none' if i < 160 else 'T22'}" for i in range(300)], "24-05-01 10:00:59,bad,T22")
    return root


def test_ecg_files(spark, raw):
    found = recordings.ecg_rows(spark, f"{raw}/T001/ECG/*.csv")
    again = recordings.ecg_rows(spark, f"{raw}/T001/ECG/*.csv", positional=True)
    assert rows(found, "subject", "t", "trigger") == rows(again, "subject", "t", "trigger") and found.count() == 68
    ordered = recordings.in_file_order(found, ["subject"]).orderBy("seq").collect()
    assert [r.seq for r in ordered] == list(range(68)) and ordered[1].samples[2] == 1.02 and ordered[63].samples[0] is None
    assert recordings.trigger_rows(found).count() == 67
    assert recordings.subjects(found, 2).count() == 0 and recordings.subjects(found, 1, 1).count() == 68 and recordings.subjects(found, names=["t001"], without=["T002"]).count() == 68


def test_samples_mode(spark, raw):
    found = flows.ecg_signal(recordings.ecg_rows(spark, f"{raw}/T001/ECG/a.csv"), "samples").orderBy("idx").collect()
    assert len(found) == 59 * 50 and found[0].value == 1.0 and found[0].t % 1_000_000 == 250_000 and found[51].value == 2.01
    with pytest.raises(ValueError):
        flows.ecg_signal(None, "both")


def test_channels_mode_to_grades(spark, raw):
    signal = tables.settled(flows.ecg_signal(recordings.ecg_rows(spark, f"{raw}/T001/ECG/*.csv"), "channels"))
    t12 = signal.where("task = 'T12'").orderBy("idx").collect()
    assert len(t12) == round(58 / 4 * 200) + 1 and t12[0].value == pytest.approx(1.245) and t12[25].value == pytest.approx(1.745)
    features, summary, grades = flows.ecg_quality(signal)
    assert rows(features, "task_id", "quality_flags")[1] == ("T22", "too_short")
    assert summary.first().TotalPoints == signal.count()
    assert dict(rows(grades, "task_id", "recommendation")) == {"T12": "drop", "T22": "drop", "T32": "drop"}
    report = sinks.quality_report(grades, quality.subject_status(grades), quality.reason_histogram(grades))
    assert "| drop | 3 | 100.0% |" in report and "missing_feature_row" in report


def test_gsr_flow(spark, raw):
    rows_ = recordings.in_file_order(recordings.gsr_rows(spark, f"{raw}/T001/GSR/*.csv"), ["subject"])
    assert rows_.where("value IS NULL").count() == 1
    found = tables.settled(flows.gsr_segments(rows_))
    assert dict(rows(found.groupBy("task").count())) == {"t12": 150, "t22": 140}
    assert found.where("idx = 0 AND task = 't12'").first().value == pytest.approx(10.0)
    assert flows.scr_of_segments(found).count() == 2


def test_processed_files_and_errors(spark, tmp_path):
    path = put(tmp_path / "T003/processed_signal_data/GSR/T003_GSR_T12_low_trust.csv", "Timestamp,Data,Trust", "2024-05-01 10:00:00.000,1.5,low", "2024-05-01 10:00:00.020,1.5x,low", "soon,2,low", "2024-05-01 10:00:00.060,nan,low")
    good, bad = recordings.processed_rows(spark, path)
    assert rows(good, "subject", "task", "row", "value", "trust") == [("T003", "T12", 2, 1.5, "low"), ("T003", "T12", 5, "nan", "low")]
    assert rows(bad, "row", "reason") == [(3, "bad value: 1.5x"), (4, "bad time: soon")]


def test_npy(spark, tmp_path):
    folder = tmp_path / "T004" / "GSR"
    folder.mkdir(parents=True)
    body = [["24-05-01 10:00:00.000", "12.5", " Anxitey "], ["24-05-01 10:00:00", "x", "T12"]]
    np.save(folder / "a.npy", np.array([recordings.NPY_COLUMNS, *body]))
    np.save(folder / "b.npy", np.array(body))
    np.save(folder / "c.npy", np.array(body, dtype=object), allow_pickle=True)
    for name in ("a", "b"):
        assert rows(recordings.npy_rows(spark, f"{folder}/{name}.npy", 0), "subject", "row", "value", "trigger") == [("T004", 0, 12.5, "anxiety"), ("T004", 1, None, "t12")]
    assert recordings.npy_rows(spark, f"{folder}/a.npy").count() == 0
    with pytest.raises(Exception, match="allow_pickle|Object arrays"):
        recordings.npy_rows(spark, f"{folder}/c.npy", 0).collect()
    assert recordings.npy_rows(spark, f"{folder}/c.npy", 0, trusted=True).count() == 2


def bmp(path, width, height, colour):
    path.parent.mkdir(parents=True, exist_ok=True)
    row = bytes(colour) * width + b"\0" * (-3 * width % 4)
    data = row * height
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(data), 0, 0, 0, 0) + data)


def test_images(spark, tmp_path):
    for i in range(3):
        bmp(tmp_path / f"T005/Image/a{i}T12.bmp", 40, 30, (10, 20, 30 + i))
    bmp(tmp_path / "T005/Image/b.bmp", 8, 8, (1, 2, 3))
    assert rows(images.files(spark, str(tmp_path)), "subject", "task") == [("T005", "T12")] * 3
    assert images.files(spark, str(tmp_path), -1).count() == 0
    pixels = images.pixels(spark, f"{tmp_path}/T005/Image/a*.bmp")
    found = images.faces(pixels, lambda image: [] if image[0, 0, 2] < 32 else 1 / 0).cache()
    assert [bool(e) for _, e in rows(found, "path", "error")] == [False, False, True]
    group = images.group_boxes(found)
    box = group.first()
    assert box.image_count == 3 and tuple(box.box) == (9, 2, 31, 30, "group_fallback_complete_visible_face")
    cut = images.grey_crops(pixels, group).orderBy("path").collect()
    assert all(r.ok for r in cut) and (cut[0].width, cut[0].height) == (22, 28) and set(cut[0].grey) == {round(0.299 * 30 + 0.587 * 20 + 0.114 * 10)}
    file = bytes(images.png_files(images.grey_crops(pixels, group)).first().file)
    (tmp_path / "x.png").write_bytes(file)
    back = spark.read.format("image").load(f"{tmp_path}/x.png").select("image.*").first()
    assert (back.width, back.height) == (22, 28) and set(back.data) == set(cut[0].grey)
    points = images.landmarks(pixels, lambda image: None)
    assert rows(points, "error") == [("no_face",)] * 3
    with pytest.raises(Exception, match="no face detection model"):
        images.missing_model("face detection")(None)


def test_sinks(spark, tmp_path):
    signal = spark.createDataFrame([("T1", "ECG", "T12", 0, 1_714_557_600_123_500, 0.5, "T12")], "subject string, modality string, task string, idx long, t long, value double, trigger string")
    sinks.write_signal(signal, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("task = 'T12'").count() == 1
    assert rows(sinks.processed_csv(signal)) == [("2024-05-01 10:00:00.124", "0.500000", "low")]
    sinks.write_splits(signal, f"{tmp_path}/split")
    split = {t: spark.read.option("header", True).csv(f"{tmp_path}/split/{t}") for t in ("combined", "T12", "T22", "T32")}
    assert [split[t].count() for t in split] == [1, 1, 0, 0] and all(df.columns == ["Timestamp", "Data", "Trust"] for df in split.values())
    sinks.write_csv(signal, f"{tmp_path}/c", ["subject", "value"])
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/c")) == [("T1", "0.5")]
    assert "&lt;b&gt;" in sinks.html_table(spark.createDataFrame([("<b>", 1.0)], "a string, b double"), "x")
    faces = spark.createDataFrame([("i", "s", "t", "c", None, 1.0, 2.0, 3.0), ("j", "s", "t", "c", "e" * 300, None, None, None)], "image_name string, subject_id string, task_id string, condition string, error string, ear_avg double, face3d_x double, au1 double")
    sinks.write_face_tables(faces, f"{tmp_path}/f")
    assert rows(spark.read.parquet(f"{tmp_path}/f/au"), "image_name", "au1") == [("i", 3.0)] and len(spark.read.parquet(f"{tmp_path}/f/failed").first().reason) == 200
    odd = signal.withColumn("reasons", F.array(F.lit("x")))
    assert rows(sinks.plot_series(odd, "T1", 1.0)) == [(0.0, 0.5, True)]


@pytest.mark.parametrize("folder", ["a b", "p[1]", "q{1}", "x%20y", "a+b", "实验", "st*r", "q?"])
def test_paths_of_any_name(spark, tmp_path, folder):
    put(tmp_path / folder / "T003/x.csv", "Timestamp,Resistance(Koum),Trigger", "24-05-01 10:00:00.000,1.5,T12")
    found = recordings.gsr_rows(spark, str(tmp_path / folder / "T003"))
    r = found.first()
    assert found.count() == 1 and (r.subject, r.value, r.row, r.seq) == ("T003", 1.5, 0, 0) and f"/{folder}/T003/x.csv" in r.file
    assert recordings.gsr_rows(spark, [str(tmp_path / folder / "T003/x.csv")]).count() == 1


def test_line_numbers_of_split_files(spark, tmp_path):
    """Files cut into many pieces, with blank lines, quoted cells, short lines, and one file without a row."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        body = lambda n, s: [x for i in range(n) for x in ([f'"24-05-01 10:00:00.{i:03d}",{i},"T12"'] if i % 7 else ["", f"24-05-01 10:00:00.{i:03d},{i}", "  "])]
        put(tmp_path / "T001/a.csv", "Timestamp,Resistance(Koum),Trigger", *body(150, 0))
        put(tmp_path / "T001/b.csv", "", "Resistance(Koum),Timestamp,Trigger", "5,24-05-01 10:00:01.000,T22", bom=False)
        put(tmp_path / "T001/c.csv", "Timestamp,Resistance(Koum),Trigger")
        put(tmp_path / "T001/d.csv", "Trigger,Resistance(Koum),More", "T32,7,x")
        put(tmp_path / "T002/a.csv", "Timestamp,Resistance(Koum),Trigger", *body(40, 1))
        got = recordings.gsr_rows(spark, [f"{tmp_path}/T001", f"{tmp_path}/T002"]).orderBy("subject", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one, two = [r for r in got if r.subject == "T001"], [r for r in got if r.subject == "T002"]
    assert [r.seq for r in one] == list(range(152)) and [r.row for r in one] == [*range(150), 0, 0]
    assert [r.value for r in one] == [*map(float, range(150)), 5.0, 7.0] and [r.trigger for r in one] == [*["T12" if i % 7 else None for i in range(150)], "T22", "T32"]
    assert [r.t is None for r in one] == [False] * 151 + [True] and [r.seq for r in two] == list(range(40)) and [r.value for r in two] == list(map(float, range(40)))


def test_broken_images(spark, tmp_path):
    bmp(tmp_path / "T005/aT12.bmp", 40, 30, (10, 20, 30))
    (tmp_path / "T005/bT12.jpg").write_bytes(b"no image")
    pixels = images.pixels(spark, f"{tmp_path}/T005")
    assert [(p.rsplit("/")[-1], e) for p, e in rows(pixels, "path", "error")] == [("aT12.bmp", None), ("bT12.jpg", "imread_failed")]
    found = images.faces(pixels, lambda image: [])
    assert [e for _, e in rows(found, "path", "error")] == [None, "imread_failed"]
    group = images.group_boxes(found)
    assert group.first().image_count == 2 and sorted((r.ok, r.message) for r in images.grey_crops(pixels, group).collect()) == [(False, "imread_failed"), (True, "")]
    assert [e for _, e in rows(images.landmarks(pixels, lambda image: None), "path", "error")] == ["no_face", "imread_failed"]


def test_columns_by_name(spark, tmp_path):
    """Files of one folder whose columns stand in different orders, one with a byte-order mark."""
    (tmp_path / "T001").mkdir()
    (tmp_path / "T001" / "a_T12_low.csv").write_text("\ufeffTimestamp,Data,Trust\n2024-01-01 00:00:00.000,1.5,low\n")
    (tmp_path / "T001" / "b_T12_low.csv").write_text("Timestamp,Trust,Data\n2024-01-01 00:00:01.000,low,2.5\n")
    good, bad = recordings.processed_rows(spark, str(tmp_path / "T001"))
    assert sorted((r.value, r.trust) for r in good.collect()) == [(1.5, "low"), (2.5, "low")] and bad.count() == 0
    rows = spark.createDataFrame([(f"T{n}",) for n in (5, 2_000_000)], "subject string")
    assert recordings.subjects(rows, first=3).count() == 2 and recordings.subjects(rows, last=10).count() == 1


@pytest.mark.parametrize("quality, away", [(100, 1.0), (95, 2.5), (50, 5.0), (5, 20.0)])
def test_jpeg(spark, tmp_path, quality, away):
    """Decoded by Spark's image source: no pixel sum is further away than half of each step of quantisation allows, and an image
    with little noise much less. Any size, flat and noisy parts."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    most = np.sqrt((np.clip(np.floor((jpeg.QUANTA * scale + 50) / 100), 1, 255) ** 2).mean()) / 2 + 1
    rng = np.random.default_rng(quality)
    y, x = np.mgrid[0:75, 0:101]
    smooth = 128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 7)
    noisy = np.clip(smooth + rng.normal(0, 4, smooth.shape) * (x > 60), 0, 255).astype(np.uint8)
    shapes = [noisy, np.full((8, 8), 255, np.uint8), np.zeros((1, 1), np.uint8), rng.integers(0, 256, (17, 9)).astype(np.uint8)]
    for i, image in enumerate(shapes):
        (tmp_path / f"{i}.jpg").write_bytes(jpeg.encode(image, quality))
    found = {r.origin.rsplit("/")[-1]: r for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    for i, image in enumerate(shapes):
        r = found[f"{i}.jpg"]
        back = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[..., 0].astype(float)
        assert back.shape == image.shape and (image.size < 64 or np.sqrt(((back - image) ** 2).mean()) < most * np.sqrt(-(-image.shape[0] // 8) * -(-image.shape[1] // 8) * 64 / image.size))
        assert i or np.abs(back - image).mean() < away
    with pytest.raises(ValueError):
        jpeg.encode(np.zeros((0, 3), np.uint8))


def test_mat_bytes():
    """Round trips; small elements, big-endian files, cells, plain and compressed parts by hand."""
    x = np.array([1.5, -2.0, np.nan])
    back = mat.decode(mat.encode({"data": x, "Timestamp": ["24-05-01", "24-05-02 ", "é"], "task_id": "joy", "user_id": "7", "none": np.empty(0)}))["mat_dict"]
    assert np.array_equal(back["data"], x[:, None], equal_nan=True) and back["Timestamp"] == ["24-05-01", "24-05-02", "é"] and (back["task_id"], back["user_id"], back["none"].size) == ("joy", "7", 0)
    big = lambda kind, data: struct.pack(">II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    short = lambda kind, data: struct.pack(">HH", len(data), kind) + data.ljust(4, b"\0")
    head = lambda kind, shape, name: big(6, struct.pack(">II", kind, 0)) + big(5, struct.pack(">2i", *shape)) + short(1, name)
    text = big(14, head(4, (1, 2), b"") + short(16, b"ab"))
    file = b" " * 124 + struct.pack(">H", 0x0100) + b"MI" + big(14, head(6, (2, 2), b"m") + big(2, bytes([1, 2, 3, 4]))) + big(14, head(1, (2, 1), b"c") + text + text)
    found = mat.decode(file)
    assert found["m"].tolist() == [[1, 3], [2, 4]] and found["c"] == ["ab", "ab"]
    with pytest.raises(ValueError):
        mat.decode(b"no file")


def test_mat_files(spark, tmp_path):
    segments = spark.createDataFrame([("T007", s, task, i, 1_714_557_600_000_000 + i * 20_000, float(s * 100 + i)) for s, task, n in ((1, "joy", 4), (2, "fear", 3), (3, "joy", 2)) for i in range(n)], "subject string, segment long, task string, idx long, t long, value double")
    for r in mat.mat_files(segments).collect():
        (tmp_path / r.path).write_bytes(bytes(r.file))
    (tmp_path / "bad.mat").write_bytes(b"x")
    found = mat.mat_rows(mat.read_mat(spark, str(tmp_path)))
    assert rows(found.where("error IS NULL"), "task_id", "idx", "value") == [("fear", 0, 200.0), ("fear", 1, 201.0), ("fear", 2, 202.0), ("joy", 0, 300.0), ("joy", 1, 301.0)]
    assert found.where("error IS NULL AND t = 1714557600000000 + idx * 20000 AND user_id = '7'").count() == 5 and found.where("error IS NOT NULL").count() == 1
