"""DuckDB SQL for the catalog's queries, written against the tables themselves."""

from __future__ import annotations

#: Fixed values, written out here too, so that a wrong place in the library shows: places in the 478-point landmark model, and
#: those in which the two profiles differ.
POINTS = {
    "right_inner": 133, "right_outer": 33, "right_upper1": 159, "right_upper2": 160, "right_lower1": 145, "right_lower2": 144,
    "left_inner": 362, "left_outer": 263, "left_upper1": 386, "left_upper2": 385, "left_lower1": 374, "left_lower2": 373,
    "right_brow_inner": 107, "right_brow_outer": 55, "right_brow_mid": 66, "left_brow_inner": 336, "left_brow_outer": 285, "left_brow_mid": 296,
    "nose": 4, "mouth_left": 61, "mouth_right": 291, "mouth_upper": 13, "mouth_lower": 14,
    "chin": 152, "forehead": 10, "face_left": 234, "face_right": 454, "jaw_left": 172, "jaw_right": 397,
}
PROFILES = {
    "combined": {"nose_base": 2, "nose_left": 98, "nose_right": 327, "right_eye": (33, 133, 157, 158, 159, 160, 161, 173), "left_eye": (362, 263, 384, 385, 386, 387, 388, 398)},
    "per_subject": {"nose_base": 5, "nose_left": 94, "nose_right": 334, "right_eye": (33, 133, 157, 158, 159, 160, 161, 163, 144, 145, 7, 173), "left_eye": (362, 263, 384, 385, 386, 387, 388, 398, 374, 373, 381, 390)},
}

TASK = "CASE user_id % 4 WHEN 0 THEN 'T12' WHEN 1 THEN 'T22' WHEN 2 THEN 'T32' END"
TRIGGERS = "['T12', ' T12 ', 't12', 'null', 'anxitey', 'terrify', 'base.', 'T22', 'T32 ', 'drive']"
RAW = f"""raw AS (
  SELECT event_type AS subject, event_id AS seq, epoch_us(ts) AS t, value, {TRIGGERS}[((user_id // 8) % 10) + 1] AS trigger, {TASK} AS task FROM events
)"""
SIGNAL = RAW + """, signal AS (
  SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS idx, t, value, task FROM raw
)"""
EN = "CASE trim(trigger) WHEN 'T12' THEN 'low' WHEN 'T22' THEN 'medium' WHEN 'T32' THEN 'high' END"
TARGET = "trim(trigger) IN ('T12', 'T22', 'T32')"
STEP = 600_000_000
CHANNELS = f"""rows_ AS (
  SELECT printf('T%03d', label) AS subject, vec_id, 1700000000000000 + vec_id * 1000003 AS t, embedding AS e, {TRIGGERS}[(vec_id % 10) + 1] AS trigger,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_no, first_value(1700000000000000 + vec_id * 1000003) OVER (PARTITION BY label ORDER BY vec_id) AS anchor FROM embeddings
)"""
GRID = f"""ends AS (SELECT subject, min(t) AS a, max(t) AS b FROM raw GROUP BY 1),
grid AS (SELECT subject, i, a + i * {STEP} AS t FROM (SELECT subject, a, unnest(range(0, (b - a) // {STEP} + 1)) AS i FROM ends)),
near AS (
  SELECT g.subject, g.i, g.t, p.t AS pt, p.value AS pv, p.trigger AS ptr, n.t AS nt, n.value AS nv, n.trigger AS ntr
  FROM grid g ASOF LEFT JOIN raw p ON g.subject = p.subject AND g.t >= p.t ASOF LEFT JOIN raw n ON g.subject = n.subject AND g.t <= n.t
)"""
LINE = "CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR pt = t THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END"
CLEAN = "CASE lower(trim(trigger)) WHEN 'anxitey' THEN 'anxiety' WHEN 'terrify' THEN 'disgust' WHEN 'null' THEN 'none' WHEN 'drive' THEN 'none' ELSE lower(trim(trigger)) END"
INVALID = "('none', 'no trigger', 'nano', 'nonenone', 'base.', 'hpaay', 'none.', '')"
ISLANDS = RAW + f""", valid AS (
  SELECT *, lag(clean) OVER (PARTITION BY subject ORDER BY t, seq) AS last FROM (SELECT subject, seq, t, {CLEAN} AS clean FROM raw) WHERE clean NOT IN {INVALID}
), runs AS (
  SELECT *, sum(CASE WHEN last IS NULL OR last <> clean THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t, seq) AS segment FROM valid
), islands AS (
  SELECT subject, segment::BIGINT AS segment, clean AS trigger, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows FROM runs GROUP BY ALL
)"""
GSR = SIGNAL + """, robust AS (
  SELECT subject, count(*) AS n, median(value) AS med, mad(value) AS mad FROM signal WHERE value > 1 AND value < 200 GROUP BY 1
), points AS (
  SELECT s.*, list_sort(list_filter([
    CASE WHEN value <= 0 THEN 'non_positive_le_0' END, CASE WHEN value = 1 THEN 'sentinel_value_1' END, CASE WHEN value >= 200 THEN 'high_resistance_ge_1000' END,
    CASE WHEN abs(value - lag(value) OVER (PARTITION BY s.subject ORDER BY idx)) >= 150 THEN 'large_step_ge_500' END,
    CASE WHEN value > 1 AND value < 200 AND n >= 20 AND mad > 0 AND 0.6745 * abs(value - med) / mad > 8 THEN 'robust_outlier_mad_gt_8' END], lambda x: x IS NOT NULL)) AS reasons
  FROM signal s LEFT JOIN robust r ON s.subject = r.subject
)"""
ECG = SIGNAL + """, robust AS (
  SELECT subject, count(*) AS n, median(value) AS med, mad(value) AS mad FROM signal WHERE abs(value) <= 200 GROUP BY 1
), sizes AS (
  SELECT subject, count(*) AS total FROM signal GROUP BY 1
), hops AS (
  SELECT subject, idx, value, unnest([idx // 10, idx // 10 - 1]) AS w FROM signal
), flat AS (
  SELECT h.subject, w FROM hops h JOIN sizes z ON h.subject = z.subject WHERE w >= 0 AND 10 * w + 20 <= total GROUP BY h.subject, w HAVING count(*) >= 2 AND stddev_pop(value) < 12.0
), flat_rows AS (
  SELECT DISTINCT h.subject, idx FROM hops h JOIN flat f ON h.subject = f.subject AND h.w = f.w
), points AS (
  SELECT s.*, list_sort(list_filter([
    CASE WHEN abs(value) > 200 THEN 'extreme_amplitude_gt_2' END, CASE WHEN abs(value - lag(value) OVER (PARTITION BY s.subject ORDER BY s.idx)) > 150 THEN 'large_step_gt_1' END,
    CASE WHEN f.idx IS NOT NULL THEN 'flatline_window' END, CASE WHEN abs(value) <= 200 AND n >= 20 AND mad > 0 AND 0.6745 * abs(value - med) / mad > 8 THEN 'robust_outlier_mad_gt_8' END], lambda x: x IS NOT NULL)) AS reasons
  FROM signal s LEFT JOIN robust r ON s.subject = r.subject LEFT JOIN flat_rows f ON s.subject = f.subject AND s.idx = f.idx
)"""
SERIOUS = "['non_finite', 'extreme_amplitude_gt_2', 'large_step_gt_1']"
STATS = """SELECT subject, min(value) AS "Min", quantile_cont(value, 0.01) AS "P01", quantile_cont(value, 0.5) AS "Median", quantile_cont(value, 0.99) AS "P99", max(value) AS "Max" FROM points GROUP BY 1"""


def _mode(value: str) -> str:
    return f"""SELECT subject, v AS "ModeValue", n / sum(n) OVER (PARTITION BY subject) AS "ModeFraction", row_number() OVER (PARTITION BY subject ORDER BY n DESC, f) AS place
  FROM (SELECT subject, {value} AS v, count(*) AS n, min(idx) AS f FROM points GROUP BY ALL)"""


def _count(reason: str) -> str:
    return f"count(*) FILTER (list_contains(reasons, '{reason}'))"


GSR_SUMMARY = (
    f"WITH {GSR}, st AS ({STATS}), md AS ({_mode('value')}), c AS ("
    """SELECT subject, count(*) AS "Rows", count(*) FILTER (len(reasons) > 0) AS "AnomalyRows", count(*) FILTER (value <= 1) AS low, count(*) FILTER (value >= 200) AS high, """
    f"""{_count('non_positive_le_0')} AS "NonPositiveRows", {_count('sentinel_value_1')} AS "SentinelOneRows", {_count('high_resistance_ge_1000')} AS "HighGe1000Rows", {_count('large_step_ge_500')} AS "LargeStepRows", {_count('robust_outlier_mad_gt_8')} AS "RobustOutlierRows" FROM points GROUP BY 1)"""
    """ SELECT c.subject AS "Subject", "Rows", "AnomalyRows", round("AnomalyRows" / "Rows", 6) AS "AnomalyFraction", round("Min", 6) AS "Min", round("P01", 6) AS "P01", round("Median", 6) AS "Median", round("P99", 6) AS "P99", round("Max", 6) AS "Max",
  round("ModeValue", 6) AS "ModeValue", round("ModeFraction", 6) AS "ModeFraction", round(low / "Rows", 6) AS "ZeroOrOneFraction", round(high / "Rows", 6) AS "HighGe1000Fraction", "NonPositiveRows", "SentinelOneRows", "HighGe1000Rows", "LargeStepRows", "RobustOutlierRows", 0::BIGINT AS "ParseErrors",
  array_to_string(list_filter([CASE WHEN low / "Rows" >= 0.05 THEN 'many_zero_or_one' END, CASE WHEN high / "Rows" >= 0.05 THEN 'many_high_ge_1000' END, CASE WHEN "ModeFraction" >= 0.8 THEN printf('flatline_mode_%.1f', "ModeValue") END], lambda x: x IS NOT NULL), '|') AS "Flags"
FROM c JOIN st USING (subject) JOIN md USING (subject) WHERE place = 1"""
)
FRACTIONS = f"""SELECT subject, task, count(*) AS n, round(count(*) FILTER (list_has_any(reasons, {SERIOUS})) / count(*), 6) AS serious_fraction, round(count(*) FILTER (len(reasons) > 0) / count(*), 6) AS all_fraction FROM points GROUP BY ALL"""
ECG_SUMMARY = (
    f"WITH {ECG}, st AS ({STATS}), md AS ({_mode('round_even(value, 6)')}), fr AS ({FRACTIONS}), c AS ("
    f"""SELECT subject, count(*) AS "TotalPoints", sum(len(list_intersect(reasons, {SERIOUS})))::BIGINT AS "SeriousAnomalyPoints", sum(len(reasons))::BIGINT AS "AllAnomalyPoints", count(*) FILTER (len(reasons) > 0) AS "AnomalyRows", count(*) FILTER (abs(value) > 200) AS extreme, """
    f"""{_count('non_finite')} AS "NonFinite", {_count('flatline_window')} AS "Flatline", {_count('extreme_amplitude_gt_2')} AS "ExtremeAmp", {_count('large_step_gt_1')} AS "LargeStep", {_count('robust_outlier_mad_gt_8')} AS "RobustOutlier" FROM points GROUP BY 1)"""
    """ SELECT c.subject AS "Subject", "TotalPoints", "SeriousAnomalyPoints", round("SeriousAnomalyPoints" / "TotalPoints", 6) AS "SeriousAnomalyFraction", "AllAnomalyPoints", round("AllAnomalyPoints" / "TotalPoints", 6) AS "AllAnomalyFraction", "AnomalyRows",
"""
    + ",\n".join(f"""  (SELECT {c} FROM fr WHERE fr.subject = c.subject AND task = '{t}') AS "{t}_{n}" """ for n, c in (("SeriousFrac", "serious_fraction"), ("AllFrac", "all_fraction")) for t in ("T12", "T22", "T32"))
    + """, round("Min", 6) AS "Min", round("P01", 6) AS "P01", round("Median", 6) AS "Median", round("P99", 6) AS "P99", round("Max", 6) AS "Max",
  round("ModeValue", 6) AS "ModeValue", round("ModeFraction", 6) AS "ModeFraction", round(extreme / "TotalPoints", 6) AS "ExtremeFraction", "NonFinite", "Flatline", "ExtremeAmp", "LargeStep", "RobustOutlier", 0::BIGINT AS "ParseErrors",
  array_to_string(list_filter([CASE WHEN extreme / "TotalPoints" >= 0.05 THEN 'many_extreme_amplitude' END, CASE WHEN "ModeFraction" >= 0.8 THEN printf('flatline_mode_%.4f', "ModeValue") END], lambda x: x IS NOT NULL), '|') AS "Flags"
FROM c JOIN st USING (subject) JOIN md USING (subject) WHERE place = 1"""
)
POINT_ROWS = "SELECT subject, idx AS row, value, array_to_string(reasons, '|') AS reasons FROM points WHERE len(reasons) > 0"
EVENT_TASK = "CASE event_type WHEN 'click' THEN 'T12' WHEN 'view' THEN 'T22' WHEN 'purchase' THEN 'T32' END"
GRADED = f"""ev AS (SELECT *, {EVENT_TASK} AS task_id FROM events),
f0 AS (
  SELECT printf('T%03d', user_id) AS user_id, task_id, count(*) AS n, stddev_pop(value) / 40 AS sd, count(*) FILTER (value > 60) AS peaks
  FROM ev WHERE task_id IS NOT NULL AND (user_id % 7 <> 3 OR task_id = 'T12') GROUP BY ALL
), f AS (SELECT *, n * 5.0 AS dur, peaks / (n * 5.0) * 600 AS rate FROM f0),
a AS (
  SELECT printf('T%03d', user_id) AS user_id, count(*) FILTER (value > 150) / count(*) AS s, count(*) FILTER (value > 100) / count(*) AS al FROM ev GROUP BY 1
), ta AS (
  SELECT printf('T%03d', user_id) AS user_id, task_id, count(*) FILTER (value > 150) / count(*) AS s, count(*) FILTER (value > 100) / count(*) AS al FROM ev WHERE task_id IS NOT NULL GROUP BY ALL
), every AS (
  SELECT user_id, task_id FROM (SELECT DISTINCT user_id FROM f), (VALUES ('T12'), ('T22'), ('T32')) v(task_id)
), j AS (
  SELECT e.user_id, e.task_id, f.n, f.sd, f.peaks, f.dur, f.rate, coalesce(nullif(ta.s, 0), a.s) AS sf, coalesce(nullif(ta.al, 0), a.al) AS af
  FROM every e LEFT JOIN f USING (user_id, task_id) LEFT JOIN ta USING (user_id, task_id) LEFT JOIN a USING (user_id)
), broken AS (
  SELECT *, CASE WHEN n IS NULL THEN [['drop', 'missing_feature_row']] ELSE list_filter([
    CASE WHEN n < 8 THEN ['drop', 'too_short_duration'] END, CASE WHEN sd < 0.3 THEN ['drop', 'flatline_signal'] END, CASE WHEN peaks < 2 THEN ['drop', 'too_few_peaks'] END,
    CASE WHEN dur < 60 THEN ['review', 'short_duration_(<60s)'] END, CASE WHEN sd > 1 THEN ['review', 'high_variation'] END, CASE WHEN peaks > 0 AND (rate < 30 OR rate > 200) THEN ['review', 'abnormal_peak_rate'] END,
    CASE WHEN sf >= 0.01 THEN ['drop', 'high_serious_anomaly_fraction_(>=1%)'] WHEN sf >= 0.001 THEN ['review', 'elevated_serious_anomaly_fraction_(>=0.1%)'] END,
    CASE WHEN af >= 0.1 THEN ['drop', 'high_all_anomaly_fraction_(>=10%)'] WHEN af >= 0.02 THEN ['review', 'elevated_all_anomaly_fraction_(>=2%)'] END], lambda x: x IS NOT NULL) END AS b FROM j
), graded AS (
  SELECT user_id, task_id, CASE WHEN list_contains(list_transform(b, lambda x: x[1]), 'drop') THEN 'drop' WHEN len(b) > 0 THEN 'review' ELSE 'keep' END AS recommendation,
    array_to_string(list_transform(b, lambda x: x[2]), ';') AS reasons, round(sf, 6) AS serious_fraction, round(af, 6) AS all_fraction FROM broken
)"""
FIVE = ", ".join(f"round(avg({v}), 4) AS {v}_mean, round(stddev_samp({v}), 4) AS {v}_std, round(median({v}), 4) AS {v}_median, round(min({v}), 4) AS {v}_min, round(max({v}), 4) AS {v}_max" for v in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
BOXES = """boxes AS (
  SELECT l_suppkey AS subject, printf('%012d-%02d-%d-%.2f-%.0f', l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS path, l_quantity AS l, l_discount * 1000 AS t, l_quantity + 400 AS r, l_tax * 1000 + 500 AS b, CASE l_returnflag WHEN 'N' THEN 1 ELSE 0 END AS found FROM lineitem
)"""


def _clamp(left: str, top: str, width: str, height: str, prefix: str, source: str, method: str) -> str:
    """Adds a whole-pixel box within 1280 x 720."""
    return f"""(SELECT *, round_even(greatest({prefix}x + 1.0, least({left} + {width}, 1280)), 0)::INT AS {prefix}r, round_even(greatest({prefix}y + 1.0, least({top} + {height}, 720)), 0)::INT AS {prefix}b, {method} AS {prefix}m
  FROM (SELECT *, round_even(greatest(0.0, least({left}, 1279.0)), 0)::INT AS {prefix}x, round_even(greatest(0.0, least({top}, 719.0)), 0)::INT AS {prefix}y FROM {source}))"""


BOX_EXPAND = f"""WITH {BOXES}, face AS (SELECT path, l * 10 + 300 AS x, t AS y, b - 400 AS w, b - 380 AS h FROM boxes),
sized AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, greatest(390.0, least(650.0, w * 2.75)) AS cw, greatest(470.0, least(680.0, h * 3.35)) AS ch FROM face),
central AS (SELECT * FROM sized WHERE cx BETWEEN 1280 * 0.34 AND 1280 * 0.74 AND cy BETWEEN 720 * 0.12 AND 720 * 0.78),
one AS {_clamp('(cx - cw / 2)', '(cy - ch * 0.40)', 'cw', 'ch', 'p', 'central', "'opencv_haar'")},
wide AS (SELECT *, greatest(pr - px, 1280 * 0.42) AS ew, greatest(pb - py, 720 * 0.68) AS eh FROM one),
placed AS (SELECT *, (px + pr) / 2 - ew / 2 AS el, (py + pb) / 2 - eh * 0.40 AS et FROM wide),
low AS (SELECT *, greatest(et + eh, 720 * 0.90) AS eb FROM placed),
fitted AS (SELECT *, et - greatest(eb - 720, 0.0) AS ft, least(eb, 720.0) AS fb FROM low),
two AS {_clamp('el', 'ft', 'ew', '(fb - ft)', 'q', 'fitted', 'pm')},
three AS {_clamp('qx', 'qy', '(qr - qx)', '(720 - qy)', 'z', 'two', 'qm')},
none AS {_clamp('(1280 * 0.5 - 1280 * 0.56 / 2)', '(720 * 0.08)', '(1280 * 0.56)', '(720 * 0.92)', 'p', '(SELECT path FROM face WHERE path NOT IN (SELECT path FROM central))', "'fallback_complete_visible_face'")}
SELECT path, CASE WHEN qb < 684 THEN zx ELSE qx END AS "left", CASE WHEN qb < 684 THEN zy ELSE qy END AS top, CASE WHEN qb < 684 THEN zr ELSE qr END AS "right", CASE WHEN qb < 684 THEN zb ELSE qb END AS bottom, qm AS method FROM three
UNION ALL SELECT path, px, py, pr, pb, pm FROM none"""


def _geometry(group: str, profile: str) -> str:
    """Over 21 points from 63 numbers, in an image of 640 x 480."""
    places = POINTS | PROFILES[profile]

    def x(i):
        return f"((e[{i % 21 * 3 + 1}] + 0.5) * 640)"

    def y(i):
        return f"((e[{i % 21 * 3 + 2}] + 0.5) * 480)"

    def z(i):
        return f"e[{i % 21 * 3 + 3}]"

    def gap(a, b):
        a, b = places[a], places[b]
        return f"sqrt(({x(a)} - {x(b)}) ** 2 + ({y(a)} - {y(b)}) ** 2)"

    def centre(side):
        a, b = places[f"{side}_inner"], places[f"{side}_outer"]
        return f"(({x(a)} + {x(b)}) / 2)", f"(({y(a)} + {y(b)}) / 2)"

    (lx, ly), (rx, ry) = centre("left"), centre("right")
    unit = f"sqrt(({lx} - {rx}) ** 2 + ({ly} - {ry}) ** 2)"
    out: dict[str, str] = {}
    if group == "ear":
        for side in ("right", "left"):
            wide = f"(2 * {gap(f'{side}_inner', f'{side}_outer')})"
            out[f"ear_{side}"] = f"CASE WHEN {wide} > 1e-9 THEN ({gap(f'{side}_upper1', f'{side}_lower2')} + {gap(f'{side}_upper2', f'{side}_lower1')}) / {wide} ELSE 'NaN'::DOUBLE END"
        r, l = out["ear_right"], out["ear_left"]
        out["ear_avg"] = f"CASE WHEN isnan({r}) THEN {l} WHEN isnan({l}) THEN {r} ELSE ({r} + {l}) / 2 END"
    elif group == "face3d":
        for name, a, b in (("width", "face_right", "face_left"), ("height", "forehead", "chin"), ("nose_to_chin", "nose", "chin"), ("nose_to_forehead", "nose", "forehead"), ("mouth_width", "mouth_right", "mouth_left"), ("mouth_height", "mouth_upper", "mouth_lower"), ("jaw_width", "jaw_right", "jaw_left"), ("nose_width", "nose_right", "nose_left")):
            out[f"face3d_{name}_ratio"] = f"{gap(a, b)} / unit"
        nose = places["nose"]
        out |= {"face3d_nose_depth": z(nose), "face3d_nose_protrusion": f"{z(nose)} - ({z(places['forehead'])} + {z(places['chin'])}) / 2", "face3d_nose_offset": f"{x(nose)} - ({x(places['face_left'])} + {x(places['face_right'])}) / 2", "face3d_inter_eye_dist_norm": "unit"}
        for side in ("left", "right"):
            eye = places[f"{side}_eye"]
            for name, f in (("h", y), ("w", x)):
                all_ = ", ".join(map(f, eye))
                out[f"face3d_{side}_eye_{name}"] = f"(greatest({all_}) - least({all_})) / unit"
            out[f"face3d_eye_z_{side}"] = f"({' + '.join(map(z, eye))}) / {len(eye)}"
    else:
        for side, (mx, my) in (("right", (rx, ry)), ("left", (lx, ly))):
            s, tall, wide, mid = side[0], f"{gap(f'{side}_upper1', f'{side}_lower1')} / unit", f"{gap(f'{side}_inner', f'{side}_outer')} / unit", places[f"{side}_brow_mid"]
            out |= {f"au1_inner_brow_raise_{s}": f"{gap(f'{side}_brow_inner', f'{side}_inner')} / unit", f"au2_outer_brow_raise_{s}": f"{gap(f'{side}_brow_outer', f'{side}_outer')} / unit", f"au4_brow_lower_{s}": f"sqrt(({mx} - {x(mid)}) ** 2 + ({my} - {y(mid)}) ** 2) / unit", f"au6_cheek_raise_{s}": tall, f"au7_lid_tighten_{s}": tall, f"au43_eye_closure_{s}": f"({tall}) * ({wide})"}
        a, b = y(places["mouth_left"]), y(places["mouth_right"])
        mouth, jaw, chin = f"{gap('mouth_left', 'mouth_right')} / unit", gap("jaw_right", "jaw_left"), f"{gap('mouth_lower', 'chin')} / unit"
        out |= {"au15_lip_corner_depress_r": f"({a} - ({a} + {b}) / 2) / unit", "au15_lip_corner_depress_l": f"({b} - ({a} + {b}) / 2) / unit", "au9_nose_wrinkle": f"{gap('nose_left', 'nose_right')} / unit", "au10_upper_lip_raise": f"{gap('mouth_upper', 'nose_base')} / unit"}
        out |= {"au12_lip_corner_pull": mouth, "au17_chin_raise": chin, "au20_lip_stretch": f"CASE WHEN {jaw} > 0 THEN {mouth} * unit / {jaw} ELSE {mouth} END", "au25_lips_part": f"{gap('mouth_upper', 'mouth_lower')} / unit", "au26_jaw_drop": chin, "au_smile_index": mouth}
    columns = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in out.items())
    return f"WITH em AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, e, CASE WHEN {unit} < 1e-9 THEN 1.0 ELSE {unit} END AS unit FROM em) SELECT vec_id, {columns} FROM u"


ORACLES = {
    "fixed_rate_expand": f"""WITH {CHANNELS} SELECT subject, {EN} AS trust, row_no * 50 + o AS sample_idx, ((anchor + (row_no * 50 + o) * 5000 + 500) // 1000) * 1000 AS t, round(e[o + 1]::DOUBLE, 6) AS value
        FROM (SELECT *, unnest(range(0, 50)) AS o FROM rows_ WHERE {TARGET})""",
    "fixed_rate_restamp": f"""WITH {RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS i, first_value(t) OVER (PARTITION BY subject ORDER BY seq) AS anchor FROM raw)
        SELECT subject, trim(trigger) AS trigger, i AS sample_idx, anchor + i * 20000 AS t, value FROM n WHERE {TARGET}""",
    "channel_mean": 'SELECT vec_id AS "order", round(list_avg(embedding[1:50]::DOUBLE[]), 6) AS mean FROM embeddings',
    "label_map_filter": f"""WITH {RAW} SELECT seq, trim(trigger) AS task, CASE trim(trigger) WHEN 'T12' THEN '低' WHEN 'T22' THEN '中' ELSE '高' END AS zh, {EN} AS en, {EN} || '_trust' AS condition FROM raw WHERE {TARGET}""",
    "trigger_normalise": f"WITH {RAW} SELECT {CLEAN} AS trigger, count(*) AS n, {CLEAN} NOT IN {INVALID} AS valid FROM raw GROUP BY ALL",
    "resample_linear": f"WITH {RAW}, {GRID} SELECT subject, i, t, round({LINE}, 6) AS value FROM near",
    "trigger_asof_forward": f"WITH {RAW}, {GRID} SELECT subject, i, t, CASE WHEN nt IS NULL THEN ptr ELSE ntr END AS trigger FROM near",
    "segment_resample": f"""WITH {RAW}, kept AS (SELECT * FROM raw WHERE task IS NOT NULL), ends AS (SELECT subject, task, min(t) AS a, max(t) AS b FROM kept GROUP BY ALL HAVING count(*) >= 2),
        grid AS (SELECT subject, task, i, a + i * {STEP} AS t FROM (SELECT *, unnest(range(0, round_even((b - a) / {STEP}, 0)::BIGINT + 1)) AS i FROM ends)),
        near AS (SELECT g.subject, g.task, g.i, g.t, p.t AS pt, p.value AS pv, n.t AS nt, n.value AS nv FROM grid g ASOF LEFT JOIN kept p ON g.subject = p.subject AND g.task = p.task AND g.t >= p.t ASOF LEFT JOIN kept n ON g.subject = n.subject AND g.task = n.task AND g.t <= n.t)
        SELECT subject, task, i, t, round({LINE}, 6) AS value FROM near""",
    "trigger_islands": f"WITH {ISLANDS} SELECT * FROM islands",
    "segment_reslice": f"""WITH {ISLANDS}, met AS (SELECT i.subject, i.segment, i.trigger AS segment_trigger, r.seq, r.value, count(*) OVER (PARTITION BY i.subject, i.segment) AS n FROM islands i JOIN raw r ON i.subject = r.subject AND r.t BETWEEN i.start_t AND i.end_t)
        SELECT subject, segment, segment_trigger, seq, value FROM met WHERE n >= 4""",
    "conductance": "SELECT event_id AS seq, round(1000.0::DOUBLE / CASE WHEN floor(value) = 0 THEN 1e-9::DOUBLE ELSE floor(value) END, 6) AS microsiemens FROM events",
    "sampling_rate_estimate": f"""WITH {SIGNAL}, d AS (SELECT subject, (t - lag(t) OVER (PARTITION BY subject ORDER BY idx)) / 1e6 AS step FROM signal)
        SELECT subject, round(coalesce(1 / (median(step) FILTER (step > 0)), 50.0), 6) AS rate FROM d GROUP BY 1""",
    "gsr_anomaly_points": f"WITH {GSR} {POINT_ROWS}",
    "gsr_anomaly_summary": GSR_SUMMARY,
    "ecg_anomaly_points": f"WITH {ECG} {POINT_ROWS}",
    "ecg_anomaly_summary": ECG_SUMMARY,
    "condition_fractions": f"WITH {ECG} {FRACTIONS}",
    "reason_counts": f"WITH {ECG} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM points) GROUP BY 1",
    "top_anomaly_subjects": f"WITH {GSR} SELECT subject, count(*) FILTER (len(reasons) > 0) AS odd FROM points GROUP BY 1 ORDER BY odd DESC, subject LIMIT 3",
    "value_mode": f"""WITH {SIGNAL}, points AS (SELECT * FROM signal), md AS ({_mode('value')}) SELECT subject, round("ModeValue", 6) AS mode_value, round("ModeFraction", 6) AS mode_fraction FROM md WHERE place = 1""",
    "value_histogram": """WITH e AS (SELECT min(value) AS a, (max(value) - min(value)) / 240 AS w FROM events), n AS (SELECT least(floor((value - a) / w), 239)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
        SELECT b.bin::INT AS bin, coalesce(n.n, 0) AS n, round(a + b.bin * w, 6) AS low, round(a + (b.bin + 1) * w, 6) AS high FROM (SELECT unnest(range(0, 240)) AS bin) b LEFT JOIN n ON b.bin = n.bin, e""",
    "quality_grade": f"WITH {GRADED} SELECT * FROM graded",
    "quality_subject_status": f"""WITH {GRADED}, c AS (SELECT user_id, count(*) FILTER (recommendation = 'keep') AS keep_count, count(*) FILTER (recommendation = 'review') AS review_count, count(*) FILTER (recommendation = 'drop') AS drop_count FROM graded GROUP BY 1)
        SELECT *, CASE WHEN review_count + drop_count = 0 THEN 'ok' WHEN drop_count >= 2 THEN 'drop' ELSE 'review' END AS status FROM c""",
    "drop_reason_counts": f"WITH {GRADED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM graded WHERE recommendation = 'drop') WHERE reason <> '' GROUP BY 1",
    "feature_group_summary": f"SELECT l_returnflag, l_linestatus, count(*) AS rows, {FIVE} FROM lineitem GROUP BY ALL",
    "box_group_median": f"""WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM boxes),
        chosen AS (SELECT * FROM o WHERE n <= 15 OR list_contains(list_transform(range(0, 15), lambda k: floor(k * (n - 1) / 14)::BIGINT), i)), u AS (SELECT *, sum(found) OVER (PARTITION BY subject) AS f FROM chosen)
        SELECT subject, count(*) AS n, round(median(l), 6) AS "left", round(median(t), 6) AS top, round(median(r), 6) AS "right", round(median(b), 6) AS bottom FROM u WHERE f < 3 OR found = 1 GROUP BY 1""",
    "box_expand": BOX_EXPAND,
    "group_boxes": f"""WITH {BOXES}, e AS (SELECT * FROM ({BOX_EXPAND})), o AS (SELECT subject, path, row_number() OVER (PARTITION BY subject ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM boxes),
        chosen AS (SELECT o.subject, n, e.* FROM o JOIN e ON o.path = e.path WHERE n <= 15 OR list_contains(list_transform(range(0, 15), lambda k: floor(k * (n - 1) / 14)::BIGINT), i)),
        u AS (SELECT *, count(*) FILTER (method = 'opencv_haar') OVER (PARTITION BY subject) AS f FROM chosen),
        m AS (SELECT subject, max(n) AS image_count, median("left") AS l, median(top) AS t, median("right") AS r, median(bottom) AS b, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM u WHERE f < 3 OR method = 'opencv_haar' GROUP BY 1),
        c AS (SELECT *, round_even(greatest(0.0, least(l, 1279.0)), 0)::INT AS x, round_even(greatest(0.0, least(t, 719.0)), 0)::INT AS y FROM m)
        SELECT subject::VARCHAR AS subject, image_count, x AS "left", y AS top, round_even(greatest(x + 1.0, least(r, 1280)), 0)::INT AS "right", round_even(greatest(y + 1.0, least(b, 720)), 0)::INT AS bottom, 'group_' || methods AS method FROM c""",
    "dedup_first": f"WITH {RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY seq) AS k FROM raw WHERE task IS NOT NULL) SELECT subject, task, seq, value FROM n WHERE k = 1",
    "set_difference": "SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 150",
    "semi_existing": "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE value > 250)",
    "missing_input_status": "SELECT c_custkey AS subject, count(o_custkey) AS files, CASE WHEN count(o_custkey) = 0 THEN 'no_input_csv' ELSE 'ok' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
} | {f"{name}_geometry_{profile}": _geometry(name, profile) for name in ("ear", "face3d", "au") for profile in PROFILES}
