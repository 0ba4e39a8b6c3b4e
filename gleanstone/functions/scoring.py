"""Scores: piecewise-linear maps, bands, fusion, and the knots and weights they take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knots (x, score) of the piecewise maps, and weights.
KNOTS = {
    "contact": [(0, 0), (0.30, 40), (0.55, 100), (0.75, 100), (0.85, 90), (1, 70)],
    "gaze_stability": [(0, 70), (0.01, 100), (0.05, 100), (0.10, 75), (0.15, 55), (0.25, 25), (0.40, 0)],
    "head_movement": [(0, 40), (1.5, 75), (3, 100), (8, 100), (12, 70), (20, 30), (35, 0)],
    "head_pitch": [(0, 100), (10, 100), (15, 85), (25, 55), (40, 20), (55, 0)],
    "head_yaw": [(0, 100), (15, 100), (25, 80), (40, 50), (55, 15), (70, 0)],
    "hand_presence": [(0, 30), (0.15, 60), (0.30, 100), (0.60, 100), (0.80, 75), (1, 50)],
    "hand_speed": [(0, 50), (0.02, 75), (0.05, 100), (0.15, 100), (0.30, 60), (0.60, 20), (1, 0)],
    "hand_fidget": [(0, 100), (0.05, 100), (0.10, 85), (0.20, 60), (0.35, 30), (0.50, 0)],
    "smile": [(0, 40), (0.10, 75), (0.20, 100), (0.45, 100), (0.65, 70), (0.85, 30)],
    "expressiveness": [(0, 40), (0.03, 75), (0.06, 100), (0.12, 100), (0.20, 60), (0.35, 20)],
    "eye_aspect": [(0.15, 30), (0.25, 70), (0.32, 100), (0.40, 100), (0.50, 60)],
    "brow": [(0, 70), (0.005, 90), (0.015, 100), (0.030, 70), (0.050, 30), (0.080, 0)],
    "wpm": [(0, 0), (60, 20), (100, 60), (130, 100), (170, 100), (210, 75), (260, 40), (350, 0)],
    "filler_ratio": [(0, 100), (0.02, 100), (0.05, 85), (0.10, 60), (0.15, 30), (0.25, 0)],
    "pauses_per_min": [(0, 60), (3, 85), (6, 100), (10, 100), (16, 70), (25, 30), (40, 0)],
    "long_pause_share": [(0, 100), (0.05, 100), (0.15, 85), (0.30, 60), (0.50, 30), (0.80, 0)],
}
FUSION = {"eye_contact": 0.20, "head_pose": 0.15, "hand_gesture": 0.10, "facial_expression": 0.15, "answer_quality": 0.40}
BANDS = [(85, "Excellent"), (70, "Good"), (55, "Fair"), (40, "Needs Work")]


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, constant beyond them; null stays null."""
    out = F.when(x <= knots[0][0], float(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.when(x > knots[-1][0], float(knots[-1][1]))


def piecewise_sql(x: str, knots: list[tuple[float, float]]) -> str:
    """The same map as a SQL expression."""
    parts = [f"WHEN {x} <= {float(knots[0][0])} THEN {float(knots[0][1])}"]
    parts += [f"WHEN {x} <= {float(x1)} THEN {float(y0)} + {float(y1 - y0)} * ({x} - {float(x0)}) / {float(x1 - x0)}" for (x0, y0), (x1, y1) in zip(knots, knots[1:])]
    return f"CASE {' '.join(parts)} WHEN {x} > {float(knots[-1][0])} THEN {float(knots[-1][1])} END"


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def band(score: Column) -> Column:
    """English band of a score; null stays null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("Priority")


def band_index(score: Column) -> Column:
    """0 (Priority) to 4 (Excellent)."""
    out = F.when(score.isNull(), F.lit(None).cast("int"))
    for i, (least, _) in enumerate(BANDS):
        out = out.when(score >= least, 4 - i)
    return out.otherwise(0)


def weighted_fusion(scores: dict[str, Column], weights: dict[str, float] = FUSION) -> Column:
    """Weighted mean of the scores that are there; null if none is."""
    there = {k: F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in scores.items()}
    total = sum(there.values())
    return F.try_divide(sum(F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in scores.items()), total)
