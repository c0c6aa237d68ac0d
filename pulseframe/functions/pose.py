"""Head pose from six landmarks: a rigid model is fitted to their pixels by damped least squares, all faces of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.faces import POINTS

#: The model's points, in millimetres.
MODEL = {"nose": (0.0, 0.0, 0.0), "chin": (0.0, -63.6, -12.5), "left_inner": (-35.0, 20.0, -20.0), "right_inner": (35.0, 20.0, -20.0), "mouth_left": (-28.0, -32.0, -5.0), "mouth_right": (28.0, -32.0, -5.0)}
STEPS = 200
FACES = 1 << 14  #: fitted at once
STARTS = np.array([(np.pi, 0, 0), (0, 0, 0), (0, np.pi, 0), (0, 0, np.pi)])  #: rotations that fits start from


def rotation(r: np.ndarray) -> np.ndarray:
    """Rotations about axes r (..., 3) by their lengths."""
    angle = np.linalg.norm(r, axis=-1)[..., None, None]
    x, y, z = np.moveaxis(r / np.maximum(angle[..., 0], 1e-300), -1, 0)
    o = np.zeros_like(x)
    k = np.stack([np.stack(row, -1) for row in ((o, -z, y), (z, o, -x), (-y, x, o))], -2)
    return np.where(angle < 1e-12, np.eye(3), np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k)


def project(pose: np.ndarray, model: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Pixels (faces, points, 2) of the model's points by pinholes of the images' widths as focal lengths."""
    seen = model @ np.swapaxes(rotation(pose[..., :3]), -1, -2) + pose[..., None, 3:]
    return width[:, None, None] * seen[..., :2] / seen[..., 2:] + np.stack((width, height), -1)[:, None] / 2


def _descended(pose: np.ndarray, pixels: np.ndarray, model: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped steps of all faces together, a damping each; a face whose error no longer falls is left as it is."""
    away = lambda p, rows: (project(p, model, width[rows], height[rows]) - pixels[rows]).reshape(len(rows), -1)
    pose, damping, error = pose.copy(), np.full(len(pose), 1e-3), np.full(len(pose), np.inf)
    rows = np.arange(len(pose))
    for _ in range(STEPS):
        if not len(rows):
            break
        now = away(pose[rows], rows)
        slope = np.stack([(away(pose[rows] + d, rows) - now) / 1e-6 for d in np.eye(6) * 1e-6], -1)
        square = np.swapaxes(slope, 1, 2) @ slope
        diagonal = np.einsum("fii->fi", square)
        damped = square + (damping[rows, None] * (diagonal + 1e-12))[:, :, None] * np.eye(6)
        damped = np.where(np.isfinite(damped).all(axis=(1, 2))[:, None, None], damped, np.eye(6))
        step = np.linalg.solve(damped + 1e-14 * np.eye(6), (np.swapaxes(slope, 1, 2) @ now[..., None]))[..., 0]
        new = pose[rows] - step
        before, after = (now**2).sum(1), (away(new, rows) ** 2).sum(1)
        better = after < before
        pose[rows[better]] = new[better]
        error[rows] = np.where(better, after, before)
        damping[rows] = np.where(better, damping[rows] / 5, damping[rows] * 5)
        done = np.where(better, before - after < 1e-12 * (1 + before), damping[rows] > 1e12) | ~np.isfinite(before)
        rows = rows[~done]
    return pose, error


def fit(pixels: np.ndarray, model: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Of each face (pixels: faces, points, 2): rotation vector and shift of least squared pixel error, from several starts the
    best that lies before the camera; NaN without one."""
    spread = np.ptp(pixels, axis=1).max(axis=1, initial=0.0)
    good = np.isfinite(pixels).all(axis=(1, 2)) & (spread >= 1e-9) & np.isfinite(width) & np.isfinite(height)
    best, least = np.full((len(pixels), 6), np.nan), np.full(len(pixels), np.inf)
    rows = np.flatnonzero(good)
    w, h, seen = width[rows], height[rows], pixels[rows]
    depth = w * np.ptp(model, axis=0).max() / spread[rows]
    shift = (seen.mean(axis=1) - np.stack((w, h), -1) / 2) * (depth / w)[:, None]
    for start in STARTS:
        with np.errstate(all="ignore"):
            pose, error = _descended(np.concatenate((np.tile(start, (len(rows), 1)), shift, depth[:, None]), 1), seen, model, w, h)
        won = (pose[:, 5] > 0) & (error < least[rows])
        best[rows[won]], least[rows[won]] = pose[won], error[won]
    return best


def angles(turn: np.ndarray) -> np.ndarray:
    """yaw, pitch and roll in degrees of rotations (..., 3, 3); yaw from the first column, roll from the last row."""
    flat = np.hypot(turn[..., 0, 0], turn[..., 1, 0])
    upright = flat > 1e-6
    yaw = np.where(upright, np.arctan2(turn[..., 1, 0], turn[..., 0, 0]), np.arctan2(-turn[..., 0, 1], turn[..., 1, 1]))
    roll = np.where(upright, np.arctan2(turn[..., 2, 1], turn[..., 2, 2]), 0.0)
    return np.degrees(np.stack((yaw, np.arctan2(-turn[..., 2, 0], flat), roll), -1))


def head_pose(landmarks: Column, width: Column, height: Column) -> Column:
    """struct<yaw_deg, pitch_deg, roll_deg>, null where no pose fits."""
    model = np.array(list(MODEL.values()))
    names = ["yaw_deg", "pitch_deg", "roll_deg"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(points: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        none = [np.nan] * (2 * len(model))
        flat = np.array([none if p is None or len(p) != 2 * len(model) else p for p in points], float).reshape(-1, len(model), 2)
        w, h = width.to_numpy(float), height.to_numpy(float)
        found = np.concatenate([fit(flat[at : at + FACES] * np.stack((w, h), -1)[at : at + FACES, None], model, w[at : at + FACES], h[at : at + FACES]) for at in range(0, len(flat), FACES)] or [np.empty((0, 6))])
        turned = angles(rotation(np.nan_to_num(found[:, :3])))
        return pd.DataFrame(np.where(np.isnan(found[:, :1]), np.nan, turned), columns=names)

    point = [F.get(landmarks, F.lit(POINTS[p])) for p in MODEL]
    flat = F.array(*[p[c].cast("double") for p in point for c in ("x", "y")])
    found = run(F.when(landmarks.isNotNull(), F.transform(flat, lambda x: F.coalesce(x, F.lit(float("nan"))))), width, height)
    return F.when(found["yaw_deg"].isNotNull() & ~F.isnan(found["yaw_deg"]), found)
