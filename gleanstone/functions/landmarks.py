"""Geometry of face landmarks: eyes, head pose, states of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Landmark numbers (outer, inner, top, bottom, iris of either eye; nose) and thresholds.
RIGHT, LEFT, NOSE = (33, 133, 159, 145, 468), (263, 362, 386, 374, 473), 1
POSE_POINTS = (1, 152, 33, 263, 61, 291)
FACE_MODEL = np.array([[0.0, 0.0, 0.0], [0.0, -63.6, -12.5], [-43.3, 32.7, -26.0], [43.3, 32.7, -26.0], [-28.9, -28.9, -24.1], [28.9, -28.9, -24.1]])
YAW, PITCH, SMILE_WIDTH, SMILE_OPEN, GESTURE_SPEED = 20.0, 20.0, 0.45, 0.05, 0.5


def point(face: Column, i: int, aspect: Column) -> tuple[Column, Column]:
    """Landmark ``i`` with x scaled by the frame's aspect."""
    p = F.get(face, F.lit(i))
    return p["x"] * aspect, p["y"]


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def eye(face: Column, ids: tuple[int, ...], aspect: Column) -> tuple[Column, Column]:
    """Openness (height over width) and the iris' position between the corners (0 outer, 1 inner)."""
    outer, inner, top, bottom, iris = (point(face, i, aspect) for i in ids)
    width = distance(outer, inner)
    along = ((iris[0] - outer[0]) * (inner[0] - outer[0]) + (iris[1] - outer[1]) * (inner[1] - outer[1])) / (width * width)
    return distance(top, bottom) / width, along


def head_proxy(face: Column, aspect: Column) -> tuple[Column, Column]:
    """Sideways and vertical offset of the nose from the eyes' middle, in distances between the eyes."""
    r, l, n = point(face, RIGHT[0], aspect), point(face, LEFT[0], aspect), point(face, NOSE, aspect)  # noqa: E741
    span = distance(r, l)
    return (n[0] - (r[0] + l[0]) / 2) / span, (n[1] - (r[1] + l[1]) / 2) / span


def head_state(yaw: Column, pitch: Column) -> Column:
    """Turned state; sideways before up and down."""
    return F.when(yaw > YAW, "turned_right").when(yaw < -YAW, "turned_left").when(pitch > PITCH, "turned_up").when(pitch < -PITCH, "turned_down").when(yaw.isNotNull(), "centered")


def smile(face: Column, aspect: Column) -> Column:
    """Smiling or neutral from the mouth's width and openness against the face's width; no face is neutral."""
    mouth = distance(point(face, 61, aspect), point(face, 291, aspect))
    wide = mouth / distance(point(face, 33, aspect), point(face, 263, aspect))
    opened = distance(point(face, 13, aspect), point(face, 14, aspect)) / mouth
    return F.when((wide > SMILE_WIDTH) & (opened > SMILE_OPEN), "smiling").otherwise("neutral")


def gaze_state(h: Column, v: Column, usual_h: Column, usual_v: Column, openness: Column, open_level: Column) -> Column:
    """State of a frame against the clip's own medians; low lids under max(0.12, 0.65 of the open level)."""
    return (
        F.when(openness.isNull(), "no_face").when(openness < F.greatest(F.lit(0.12), 0.65 * open_level), "low_lids")
        .when((F.abs(h - usual_h) > 0.08) | (F.abs(v - usual_v) > 0.10), "looking_away").otherwise("eye_contact")
    )


def solve_pose(image: np.ndarray, aspect: float, rounds: int = 30) -> tuple[float, float, float] | None:
    """Pitch, yaw and roll in degrees of six image points by damped Gauss-Newton on a pinhole camera."""
    if image.shape != (6, 2) or not np.isfinite(image).all():
        return None
    center = np.array([aspect / 2, 0.5])
    target = image - center
    p = np.array([np.pi, 0.0, 0.0, 0.0, 0.0, 400.0])

    def rotation(r: np.ndarray) -> np.ndarray:
        a = np.linalg.norm(r)
        if a < 1e-12:
            return np.eye(3)
        k = r / a
        m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return np.eye(3) + np.sin(a) * m + (1 - np.cos(a)) * m @ m

    def project(q: np.ndarray) -> np.ndarray:
        x = FACE_MODEL @ rotation(q[:3]).T + q[3:]
        return (x[:, :2] / x[:, 2:]).ravel()

    goal, damp = target.ravel(), 1e-3
    error = np.sum((project(p) - goal) ** 2)
    for _ in range(rounds):
        base = project(p)
        jac = np.stack([(project(p + h) - base) / s for s, h in ((1e-6 * (1 if i < 3 else 100), np.eye(6)[i] * 1e-6 * (1 if i < 3 else 100)) for i in range(6))], 1)
        a = jac.T @ jac
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (goal - base))
        new = np.sum((project(p + step) - goal) ** 2)
        if np.isfinite(new) and new < error:
            done = error - new < 1e-14
            p, error, damp = p + step, new, damp / 5
            if done:
                break
        else:
            damp *= 8
            if damp > 1e8:
                break
    r = rotation(p[:3]) @ np.diag([1.0, -1.0, -1.0])  # so that a frontal face is at rest
    flat = np.hypot(r[0, 0], r[1, 0])
    if flat > 1e-6:
        angles = np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], flat), np.arctan2(r[1, 0], r[0, 0])
    else:
        angles = np.arctan2(-r[1, 2], r[1, 1]), np.arctan2(-r[2, 0], flat), 0.0
    return tuple(float(np.degrees(x)) for x in angles)


_POSE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("pitch", "yaw", "roll")])


@F.pandas_udf(_POSE)
def head_pose(points: pd.Series, aspect: pd.Series) -> pd.DataFrame:
    """Angles of six (x, y) points each; null where they can't be had."""
    got = [solve_pose(np.array([[q["x"] * a, q["y"]] for q in p], float), float(a)) if p is not None and len(p) == 6 else None for p, a in zip(points, aspect)]
    return pd.DataFrame([g or (None, None, None) for g in got], columns=["pitch", "yaw", "roll"], dtype="float64")
