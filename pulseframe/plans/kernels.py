"""Queries of the kernels over blocks, of recordings' files in order, and of tables for reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import dsp, faces, values
from pulseframe.functions.labels import is_target
from pulseframe.functions.pose import head_pose
from pulseframe.operators import expand, features, quality, series
from pulseframe.plans import flows, proxies
from pulseframe.plans.oracles import GRADED, SIGNAL
from pulseframe.plans.roundtrips import SUBJECTS, raw_files, rounded
from pulseframe.sources import mat, recordings, sinks
from pulseframe.sources.tables import scratch_path, settled

KEYS = features.KEYS
SIZE = 512  #: samples of a block: series here are cut into several


def _subject(name: str):
    return F.coalesce(*[F.when(F.col(name) == k, v) for k, v in SUBJECTS.items()]).alias("subject")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = proxies.signal(spark, sf_dir).withColumn("task", F.lit("all"))
    return series.packed(signal, KEYS, SIZE)


def zero_phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.zero_phase(_blocks(spark, sf_dir), KEYS, dsp.butterworth_sections(3, (0.5, 5.0), 200.0), SIZE)
    return rounded(series.samples(found, KEYS).select("subject", "idx", "value"))


def series_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.maxima(_blocks(spark, sf_dir), KEYS).drop("task"))


def welch_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.spectra(_blocks(spark, sf_dir), KEYS, 200.0, F.lit(64), F.lit(64), SIZE, 0.1, 100.0)
    return rounded(found.select("subject", F.col("bin").cast("long").alias("bin"), "freq", "power"))


def tonic_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.tonic_phasic(series.filled(_blocks(spark, sf_dir), KEYS), 5.0, SIZE)
    both = found.select("subject", "start", F.posexplode(F.arrays_zip("tonic", "x")).alias("at", "v"))
    return rounded(both.select("subject", (F.col("start") + F.col("at")).alias("idx"), F.col("v.tonic").alias("tonic"), F.col("v.x").alias("phasic")))


def csv_trigger_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each label's rows stand among all rows of a subject's files."""
    return recordings.trigger_rows(recordings.gsr_rows(spark, raw_files(spark, sf_dir))).select("subject", "trigger", "seq")


def csv_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by place, in files whose columns stand in one order."""
    paths = [p for p in raw_files(spark, sf_dir) if "T002" not in p]
    return recordings.gsr_rows(spark, paths, positional=True).select("subject", "seq", "t", "value", F.trim("trigger").alias("trigger"))


def processed_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed files of each task, put together as each subject's signal."""
    rows = proxies.raw_events(spark, sf_dir).where(is_target(F.col("trigger"))).withColumn("trigger", F.trim("trigger"))
    top = scratch_path(spark, "processed")
    paths = []
    for event, subject in SUBJECTS.items():
        for task, name in (("T12", "low"), ("T22", "medium"), ("T32", "high")):
            own = rows.where((F.col("subject") == event) & (F.col("trigger") == task)).orderBy("seq").coalesce(1)
            sinks.write_csv(sinks.processed_csv(own), f"{top}/{subject}/{subject}_GSR_{task}_{name}_trust.csv")
            paths.append(f"{top}/{subject}/{subject}_GSR_{task}_{name}_trust.csv")
    good, _ = recordings.processed_rows(spark, paths)
    return rounded(flows.processed_signal(good).select("subject", "task", "idx", "place", "value"))


def mat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a task as MAT files, of several the last, and back."""
    rows = proxies.signal(spark, sf_dir).where("task IS NOT NULL").select(_subject("subject"), (F.expr("idx div 100") + 1).alias("segment"), "task", "idx", "t", "value")
    path = scratch_path(spark, "mat")
    mat.mat_files(rows).write.parquet(path)
    files = spark.read.parquet(path).withColumnRenamed("file", "content")
    return rounded(mat.mat_rows(files).select("user_id", "task_id", "idx", "t", "value"))


def both_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with a task that both of two modalities have: users' clicks and their views."""
    events = proxies.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "event_type", F.when(F.col("value") > 60, "T12").when(F.col("value") > 30, "T22").otherwise("T32").alias("task"))
    one, two = (events.where(F.col("event_type") == k) for k in ("error", "signup"))
    return expand.tasks_in_both(one, two)


def event_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of events as kernels give them: some not finite, some outside the series."""
    rows = proxies.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i % 9 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(None)).otherwise(x * 100)).alias("at"))
    return rows.select("vec_id", values.event_indexes(F.col("at"), F.lit(20)).alias("at"))


def quality_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.grade(proxies.feature_rows(spark, sf_dir), proxies.anomaly_rows(spark, sf_dir))
    path = scratch_path(spark, "quality")
    sinks.write_quality_tables(settled(graded), path)
    tables = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("name"), "user_id", *(["task_id", "reasons"] if name != "summary" else [F.lit(None).cast("string").alias("task_id"), F.col("status").alias("reasons")])) for name in ("detail", "discard", "review", "summary")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


def head_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of 21-point faces; landmarks go by their place modulo 21."""
    rows = proxies.faces(spark, sf_dir)
    places = F.transform(F.sequence(F.lit(0), F.lit(max(faces.POINTS.values()))), lambda i: F.get("landmarks", i % proxies.POINTS))
    return rounded(rows.select("vec_id", head_pose(places, F.col("width"), F.col("height")).alias("p")).select("vec_id", "p.*"), 2)


QUERIES = {
    f.__name__: f
    for f in (zero_phase_filter, series_peaks, welch_power, tonic_level, csv_trigger_index, csv_positional, processed_signal, mat_segments, both_modalities, event_indexes, quality_tables, head_poses)
}

#: Fixed values of the band pass in three sections (b0, b1, b2, a1, a2), and their states in the long run for an input of ones.
SECTIONS = (
    (0.0003081210415822178, 0.0, -0.0003081210415822178, -1.9860752714129186, 0.9863392762460939),
    (1.0, 0.0, -1.0, -1.8589008839392147, 0.8803989255086141),
    (1.0, 0.0, -1.0, -1.8654481748527418, 0.867755796910841),
)
STEADY = (-0.0003081210415822178, -0.0003081210415822178, 0.0, 0.0, 0.0, 0.0)


def _steps(x: str, state: list[str]) -> str:
    """The output y and the next states z1 to z6 of the sections for an input and their states."""
    out = []
    for k, (b0, b1, b2, a1, a2) in enumerate(SECTIONS):
        y = f"({b0}::DOUBLE * {x} + {state[2 * k]})"
        out += [f"{b1}::DOUBLE * {x} - ({a1}::DOUBLE) * {y} + {state[2 * k + 1]} AS z{2 * k + 1}", f"({b2}::DOUBLE) * {x} - {a2}::DOUBLE * {y} AS z{2 * k + 2}"]
        x = y
    return ", ".join([f"{x} AS y", *out])


_CARRIED = [f"f.z{i}" for i in range(1, 7)]
_OPEN = lambda x: [f"({s}::DOUBLE * {x})" for s in STEADY]
ZERO_PHASE = f"""WITH RECURSIVE {SIGNAL}, sizes AS (SELECT subject, count(*) AS n FROM signal GROUP BY 1),
wide AS (
  SELECT subject, idx AS p, value AS x FROM signal
  UNION ALL SELECT s.subject, -s.idx, 2 * f.value - s.value FROM signal s JOIN signal f ON s.subject = f.subject AND f.idx = 0 WHERE s.idx BETWEEN 1 AND 21
  UNION ALL SELECT s.subject, 2 * (n - 1) - s.idx, 2 * f.value - s.value FROM signal s JOIN sizes z ON s.subject = z.subject JOIN signal f ON f.subject = s.subject AND f.idx = n - 1 WHERE s.idx BETWEEN n - 22 AND n - 2
), forwards AS (
  SELECT subject, p, {_steps('x', _OPEN('x'))} FROM wide WHERE p = -21
  UNION ALL SELECT w.subject, w.p, {_steps('w.x', _CARRIED)} FROM forwards f JOIN wide w ON w.subject = f.subject AND w.p = f.p + 1
), turned AS MATERIALIZED (
  SELECT subject, p, y AS x FROM forwards
), backwards AS (
  SELECT t.subject, p, {_steps('x', _OPEN('x'))} FROM turned t JOIN sizes z ON t.subject = z.subject WHERE p = n + 20
  UNION ALL SELECT w.subject, w.p, {_steps('w.x', _CARRIED)} FROM backwards f JOIN turned w ON w.subject = f.subject AND w.p = f.p - 1
)
SELECT b.subject, p AS idx, round(y, 6) AS value FROM backwards b JOIN sizes z ON b.subject = z.subject WHERE p BETWEEN 0 AND n - 1"""
PEAKS = f"""WITH {SIGNAL}, marked AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY subject ORDER BY idx) THEN 0 ELSE 1 END AS new FROM signal),
runs AS (SELECT subject, min(idx) AS s, max(idx) AS e, min(value) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY idx) AS r FROM marked) GROUP BY subject, r),
tops AS (SELECT subject, (s + e) // 2 AS pk, v FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM runs WINDOW w AS (PARTITION BY subject ORDER BY s)) WHERE v > l AND v > n),
ends AS (
  SELECT t.subject, pk, v, coalesce(max(x.idx) FILTER (x.idx < pk), -1) AS a, coalesce(min(x.idx) FILTER (x.idx > pk), 9223372036854775807) AS b
  FROM tops t LEFT JOIN signal x ON x.subject = t.subject AND x.value > v GROUP BY ALL
)
SELECT e.subject, pk AS idx, round(v, 6) AS height, round(v - greatest(min(value) FILTER (idx <= pk), min(value) FILTER (idx >= pk)), 6) AS prominence
FROM ends e JOIN signal x ON x.subject = e.subject AND idx > a AND idx < b GROUP BY e.subject, pk, v"""
WELCH = f"""WITH {SIGNAL}, sizes AS (SELECT subject, count(*) AS n FROM signal GROUP BY 1),
parts AS (SELECT s.subject, w, idx - 32 * w AS j, value FROM (SELECT *, unnest([idx // 32, idx // 32 - 1]) AS w FROM signal) s JOIN sizes z ON s.subject = z.subject WHERE w >= 0 AND 32 * w + 64 <= n),
level AS (SELECT subject, w, avg(value) AS mean FROM parts GROUP BY ALL),
seen AS (SELECT p.subject, p.w, j, (value - mean) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 64)) AS x FROM parts p JOIN level l ON p.subject = l.subject AND p.w = l.w),
turns AS (SELECT subject, w, k, sum(x * cos(2 * pi() * k * j / 64)) AS c, sum(x * sin(2 * pi() * k * j / 64)) AS s FROM seen, (SELECT unnest(range(1, 32)) AS k) GROUP BY ALL)
SELECT subject, k AS bin, round(k * 200 / 64::DOUBLE, 6) AS freq, round(2 * avg(c * c + s * s) / (200 * 24), 6) AS power FROM turns GROUP BY subject, k"""
#: Of 101 samples: polynomials orthogonal over -50 to 50, a cubic's least squares are their sums.
_T2, _T4 = sum(t**2 for t in range(-50, 51)), sum(t**4 for t in range(-50, 51))
_P = ["1", "u", f"(u * u - {_T2 / 101}::DOUBLE)", f"(u * u * u - {_T4 / _T2}::DOUBLE * u)"]
TONIC = f"""WITH {SIGNAL}, sizes AS (SELECT subject, count(*) AS n FROM signal GROUP BY 1),
weights AS (SELECT u, 3 * (3 * 2500 + 150 - 1 - 5 * u * u) / (103 * 101 * 99)::DOUBLE AS w FROM (SELECT unnest(range(-50, 51)) AS u)),
norms AS (SELECT {', '.join(f'sum({p} * {p}) AS q{i}' for i, p in enumerate(_P))} FROM weights),
inner_ AS (SELECT s.subject, s.idx, sum(x.value * w) AS tonic FROM signal s JOIN sizes z ON s.subject = z.subject JOIN weights ON true JOIN signal x ON x.subject = s.subject AND x.idx = s.idx + u WHERE s.idx BETWEEN 50 AND n - 51 GROUP BY ALL),
middles AS (SELECT subject, n, unnest([50, n - 51]) AS m FROM sizes),
fits AS (SELECT s.subject, n, m, {', '.join(f'sum(value * {p}) AS s{i}' for i, p in enumerate(_P))} FROM (SELECT s.*, n, m, idx - m AS u FROM signal s JOIN middles USING (subject) WHERE idx BETWEEN m - 50 AND m + 50) s GROUP BY ALL),
edges AS (
  SELECT subject, m + u AS idx, {' + '.join(f's{i} / q{i} * {p}' for i, p in enumerate(_P))} AS tonic FROM fits, norms, weights WHERE (m = 50 AND u < 0) OR (m = n - 51 AND u > 0)
)
SELECT subject, idx, round(tonic, 6) AS tonic, round(value - tonic, 6) AS phasic FROM (SELECT * FROM inner_ UNION ALL SELECT * FROM edges) JOIN signal USING (subject, idx)"""

_SUBJECT = "CASE subject " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBJECTS.items()) + " END"
ORACLES = {
    "zero_phase_filter": ZERO_PHASE,
    "series_peaks": PEAKS,
    "welch_power": WELCH,
    "tonic_level": TONIC,
    "csv_trigger_index": f"WITH {SIGNAL}, r AS (SELECT subject, seq, trigger, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS i FROM raw) SELECT {_SUBJECT} AS subject, trim(trigger) AS trigger, i AS seq FROM r WHERE trim(trigger) NOT IN ('', 'null')",
    "csv_positional": f"WITH {SIGNAL} SELECT {_SUBJECT} AS subject, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS seq, t // 1000 * 1000 AS t, value, trim(trigger) AS trigger FROM raw WHERE subject <> 'error'",
    "processed_signal": f"""WITH {SIGNAL}, r AS (SELECT {_SUBJECT} AS subject, trim(trigger) AS task, seq, value FROM raw WHERE trim(trigger) IN ('T12', 'T22', 'T32'))
SELECT subject, task, row_number() OVER (PARTITION BY subject, task ORDER BY seq) - 1 AS idx, row_number() OVER (PARTITION BY subject ORDER BY task, seq) - 1 AS place, round(value, 6) AS value FROM r""",
    "mat_segments": f"""WITH {SIGNAL}, r AS (SELECT {_SUBJECT} AS subject, task, idx // 100 AS segment, idx, t, value FROM signal WHERE task IS NOT NULL),
l AS (SELECT subject, task, max(segment) AS segment FROM r GROUP BY ALL)
SELECT ltrim(subject, 'T0') AS user_id, task AS task_id, row_number() OVER (PARTITION BY subject, task ORDER BY idx) - 1 AS idx, t // 1000 * 1000 AS t, round(value, 6) AS value FROM r JOIN l USING (subject, task, segment)""",
    "both_modalities": """WITH e AS (SELECT user_id AS subject, event_type, CASE WHEN value > 60 THEN 'T12' WHEN value > 30 THEN 'T22' ELSE 'T32' END AS task FROM events)
SELECT DISTINCT subject, task FROM e WHERE event_type = 'error' INTERSECT SELECT DISTINCT subject, task FROM e WHERE event_type = 'signup'""",
    "event_indexes": """SELECT vec_id, list_filter(list_transform(list_filter(list_transform(range(64), lambda i: CASE WHEN i % 9 <> 0 AND i % 11 <> 0 THEN embedding[i + 1]::DOUBLE * 100 END), lambda x: x IS NOT NULL), lambda x: trunc(x)::BIGINT), lambda i: i >= 0 AND i < 20) AS at FROM embeddings""",
    "quality_tables": f"""WITH {GRADED}, s AS (SELECT user_id, count(*) FILTER (recommendation = 'review') AS r, count(*) FILTER (recommendation = 'drop') AS d FROM graded GROUP BY 1)
SELECT 'detail' AS name, user_id, task_id, reasons FROM graded UNION ALL SELECT 'discard', user_id, task_id, reasons FROM graded WHERE recommendation = 'drop' UNION ALL SELECT 'review', user_id, task_id, reasons FROM graded WHERE recommendation = 'review'
UNION ALL SELECT 'summary', user_id, NULL, CASE WHEN r + d = 0 THEN 'ok' WHEN d >= 2 THEN 'drop' ELSE 'review' END FROM s""",
}
