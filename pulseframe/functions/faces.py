"""Facial geometry from landmarks, as expressions. landmarks: array<struct<x, y, z>>, x and y as shares of the image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places in the 478-point landmark model.
POINTS = {
    "right_inner": 133, "right_outer": 33, "right_upper1": 159, "right_upper2": 160, "right_lower1": 145, "right_lower2": 144,
    "left_inner": 362, "left_outer": 263, "left_upper1": 386, "left_upper2": 385, "left_lower1": 374, "left_lower2": 373,
    "right_brow_inner": 107, "right_brow_outer": 55, "right_brow_mid": 66, "left_brow_inner": 336, "left_brow_outer": 285, "left_brow_mid": 296,
    "nose": 4, "mouth_left": 61, "mouth_right": 291, "mouth_upper": 13, "mouth_lower": 14,
    "chin": 152, "forehead": 10, "face_left": 234, "face_right": 454, "jaw_left": 172, "jaw_right": 397,
}
#: Fixed values of the two profiles in use, which differ in the nose's base and the points of an eye.
PROFILES = {
    "combined": {"nose_base": 2, "nose_left": 98, "nose_right": 327, "right_eye": (33, 133, 157, 158, 159, 160, 161, 173), "left_eye": (362, 263, 384, 385, 386, 387, 388, 398)},
    "per_subject": {"nose_base": 5, "nose_left": 94, "nose_right": 334, "right_eye": (33, 133, 157, 158, 159, 160, 161, 163, 144, 145, 7, 173), "left_eye": (362, 263, 384, 385, 386, 387, 388, 398, 374, 373, 381, 390)},
}
TINY = 1e-9


class Face:
    """Distances between points in pixels. remap: turns a place into one of a smaller model (for proxies)."""

    def __init__(self, landmarks: Column, width: Column, height: Column, profile: str = "combined", remap=lambda i: i):
        self.landmarks, self.width, self.height, self.remap = landmarks, width, height, remap
        self.points = POINTS | PROFILES[profile]

    def at(self, point: str | int) -> tuple[Column, Column, Column]:
        """x and y in pixels, and z."""
        i = self.points[point] if isinstance(point, str) else point
        p = F.get(self.landmarks, F.lit(self.remap(i)))
        return p["x"].cast("double") * self.width, p["y"].cast("double") * self.height, p["z"].cast("double")

    def gap(self, a, b) -> Column:
        (ax, ay, *_), (bx, by, *_) = (p if isinstance(p, tuple) else self.at(p) for p in (a, b))
        return F.hypot(ax - bx, ay - by)

    def middle(self, a: str, b: str) -> tuple[Column, Column]:
        (ax, ay, _), (bx, by, _) = self.at(a), self.at(b)
        return (ax + bx) / 2, (ay + by) / 2

    def eye_distance(self) -> Column:
        gap = self.gap(self.middle("left_inner", "left_outer"), self.middle("right_inner", "right_outer"))
        return F.when(gap < TINY, 1.0).otherwise(gap)

    def eye(self, side: str) -> list[tuple[Column, Column, Column]]:
        return [self.at(i) for i in self.points[f"{side}_eye"]]


def ear(face: Face) -> dict[str, Column]:
    """Eye aspect ratios: both heights over twice the width; NaN for an eye without width."""

    def one(side: str) -> Column:
        width = 2 * face.gap(f"{side}_inner", f"{side}_outer")
        return F.when(width > TINY, (face.gap(f"{side}_upper1", f"{side}_lower2") + face.gap(f"{side}_upper2", f"{side}_lower1")) / width).otherwise(F.lit(float("nan")))

    right, left = one("right"), one("left")
    mean = F.when(F.isnan(right), left).when(F.isnan(left), right).otherwise((right + left) / 2)
    return {"ear_right": right, "ear_left": left, "ear_avg": mean}


def _spread(values: list[Column]) -> Column:
    return F.greatest(*values) - F.least(*values)


def _mean(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values) / len(values)


def face3d(face: Face) -> dict[str, Column]:
    """18 proportions, most over the distance between the eyes."""
    unit = face.eye_distance()
    nose, left, right = face.at("nose"), face.eye("left"), face.eye("right")
    (left_x, *_), (right_x, *_) = face.at("face_left"), face.at("face_right")
    ratios = {
        "width": ("face_right", "face_left"), "height": ("forehead", "chin"), "nose_to_chin": ("nose", "chin"), "nose_to_forehead": ("nose", "forehead"), "mouth_width": ("mouth_right", "mouth_left"),
        "mouth_height": ("mouth_upper", "mouth_lower"), "jaw_width": ("jaw_right", "jaw_left"), "nose_width": ("nose_right", "nose_left"),
    }
    found = {f"face3d_{name}_ratio": face.gap(*ends) / unit for name, ends in ratios.items()}
    found |= {
        "face3d_nose_depth": nose[2], "face3d_nose_protrusion": nose[2] - (face.at("forehead")[2] + face.at("chin")[2]) / 2, "face3d_nose_offset": nose[0] - (left_x + right_x) / 2,
        "face3d_inter_eye_dist_norm": unit,
    }
    for side, eye in (("left", left), ("right", right)):
        found |= {f"face3d_{side}_eye_h": _spread([p[1] for p in eye]) / unit, f"face3d_{side}_eye_w": _spread([p[0] for p in eye]) / unit, f"face3d_eye_z_{side}": _mean([p[2] for p in eye])}
    return found


def action_units(face: Face) -> dict[str, Column]:
    """22 action-unit measures, most over the distance between the eyes."""
    unit = face.eye_distance()
    over = lambda a, b: face.gap(a, b) / unit
    mouth, jaw = over("mouth_left", "mouth_right"), face.gap("jaw_right", "jaw_left")
    corner_y = (face.at("mouth_left")[1] + face.at("mouth_right")[1]) / 2
    chin = over("mouth_lower", "chin")
    found: dict[str, Column] = {}
    for side in ("right", "left"):
        s, height = side[0], over(f"{side}_upper1", f"{side}_lower1")
        found |= {
            f"au1_inner_brow_raise_{s}": over(f"{side}_brow_inner", f"{side}_inner"), f"au2_outer_brow_raise_{s}": over(f"{side}_brow_outer", f"{side}_outer"),
            f"au4_brow_lower_{s}": over(face.middle(f"{side}_inner", f"{side}_outer"), f"{side}_brow_mid"), f"au6_cheek_raise_{s}": height, f"au7_lid_tighten_{s}": height,
            f"au43_eye_closure_{s}": height * over(f"{side}_inner", f"{side}_outer"),
        }
    # the corner on the image's left is the subject's right
    found |= {"au15_lip_corner_depress_r": (face.at("mouth_left")[1] - corner_y) / unit, "au15_lip_corner_depress_l": (face.at("mouth_right")[1] - corner_y) / unit}
    return found | {
        "au9_nose_wrinkle": over("nose_left", "nose_right"), "au10_upper_lip_raise": over("mouth_upper", "nose_base"), "au12_lip_corner_pull": mouth, "au17_chin_raise": chin,
        "au20_lip_stretch": F.when(jaw > 0, mouth * unit / jaw).otherwise(mouth), "au25_lips_part": over("mouth_upper", "mouth_lower"), "au26_jaw_drop": chin, "au_smile_index": mouth,
    }
