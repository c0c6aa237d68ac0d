"""Feature tables of faces, and their summary per subject and task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import faces, labels
from pulseframe.functions.pose import head_pose
from pulseframe.operators.stats import five_numbers

BASE = ["image_name", "subject_id", "task_id", "condition"]
LEAST_POINTS = 468


def features(landmarks: DataFrame, profile: str = "combined", pose: bool | None = None) -> DataFrame:
    """landmarks(path, width, height, landmarks, error) -> names, error (null if good) and 43 measures; with pose (the
    combined profile's default) three angles more. Faces with too few points fail."""
    name = F.concat(labels.stem(F.col("path")), F.lit("."), F.regexp_extract("path", r"\.([^.]+)$", 1))
    enough = F.size("landmarks") >= LEAST_POINTS
    error = F.coalesce("error", F.when(F.col("landmarks").isNull(), "no_face_detected" if profile == "combined" else "no_face"), F.when(~enough, "too few landmarks"))
    rows = landmarks.withColumns({"image_name": name, "subject_id": labels.field(F.col("path"), 0), "task_id": F.upper(labels.field(F.col("path"), -1)), "error": labels.message(error)})
    rows = rows.withColumn("condition", labels.condition(F.col("task_id")))
    face = faces.Face(F.col("landmarks"), F.col("width"), F.col("height"), profile)
    measures = faces.ear(face) | faces.face3d(face) | faces.action_units(face)
    columns = [F.when(F.col("error").isNull(), c).alias(k) for k, c in measures.items()]
    if pose if pose is not None else profile == "combined":
        rows = rows.withColumn("_pose", head_pose(F.when(F.col("error").isNull(), F.col("landmarks")), F.col("width"), F.col("height")))
        columns += [F.col(f"_pose.{x}") for x in ("yaw_deg", "pitch_deg", "roll_deg")]
    return rows.select(*BASE, "error", *columns)


def summary(found: DataFrame) -> DataFrame:
    """subject_id, task_id, condition, image_count, and mean, std, median, min and max of each measure."""
    good = found.where("error IS NULL")
    measures = [c for c in found.columns if c not in (*BASE, "error")]
    return five_numbers(good, ["subject_id", "task_id", "condition"], measures).withColumnRenamed("rows", "image_count")
