"""Queries of landmark geometry, on coordinates taken from the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions import landmarks as L
from gleanstone.plans.base import query
from gleanstone.session import table

X = [f"embedding[{i}]::DOUBLE" for i in range(1, 21)]


def coords(spark: SparkSession, d: str) -> DataFrame:
    """vec_id and the first twenty numbers as columns v1 .. v20."""
    return table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i + 1}") for i in range(20)])


@query("mth06", f"SELECT vec_id, round(sqrt(pow(({X[0]} - {X[2]}) * 1.5, 2) + pow({X[1]} - {X[3]}, 2)), 6) AS flat, round(sqrt(pow({X[0]} - {X[3]}, 2) + pow({X[1]} - {X[4]}, 2) + pow({X[2]} - {X[5]}, 2)), 6) AS deep FROM embeddings")
def mth06(spark: SparkSession, d: str) -> DataFrame:
    """Distances of landmarks, corrected by the aspect, in two and three dimensions."""
    c = F.col
    flat = L.distance((c("v1") * 1.5, c("v2")), (c("v3") * 1.5, c("v4")))
    deep = F.sqrt((c("v1") - c("v4")) ** 2 + (c("v2") - c("v5")) ** 2 + (c("v3") - c("v6")) ** 2)
    return coords(spark, d).select("vec_id", F.round(flat, 6).alias("flat"), F.round(deep, 6).alias("deep"))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """A face array of 478 points in which the used landmarks have the row's numbers."""
    used = {i: k for k, i in enumerate((33, 133, 159, 145, 468, 263, 362, 386, 374, 473))}
    at = lambda i: F.struct(F.col(f"v{used[i] * 2 + 1}").alias("x"), F.col(f"v{used[i] * 2 + 2}").alias("y")) if i in used else None
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return coords(spark, d).select("vec_id", F.array(*[at(i) if i in used else zero for i in range(478)]).alias("face"))


@query("mth07", f"""WITH e AS (SELECT vec_id, {', '.join(f'{x} AS v{i}' for i, x in enumerate(X, 1))} FROM embeddings), w AS (SELECT *, sqrt(pow(v1 - v3, 2) + pow(v2 - v4, 2)) AS width FROM e)
SELECT vec_id, round(sqrt(pow(v5 - v7, 2) + pow(v6 - v8, 2)) / width, 5) AS openness, round(((v9 - v1) * (v3 - v1) + (v10 - v2) * (v4 - v2)) / (width * width), 5) AS iris FROM w""")
def mth07(spark: SparkSession, d: str) -> DataFrame:
    """Openness of an eye and the iris' place between its corners."""
    o, a = L.eye(F.col("face"), L.RIGHT, F.lit(1.0))
    return _faces(spark, d).select("vec_id", F.round(o, 5).alias("openness"), F.round(a, 5).alias("iris"))


@query("mth08", f"""WITH e AS (SELECT vec_id, {', '.join(f'{x} AS v{i}' for i, x in enumerate(X, 1))} FROM embeddings), w AS (SELECT *, sqrt(pow(v1 - v11, 2) + pow(v2 - v12, 2)) AS span FROM e)
SELECT vec_id, round((0 - (v1 + v11) / 2) / span, 5) AS yaw, round((0 - (v2 + v12) / 2) / span, 5) AS pitch FROM w""")
def mth08(spark: SparkSession, d: str) -> DataFrame:
    """Head direction from the nose and the eyes, in distances between the eyes."""
    y, p = L.head_proxy(F.col("face"), F.lit(1.0))
    return _faces(spark, d).select("vec_id", F.round(y, 5).alias("yaw"), F.round(p, 5).alias("pitch"))


@query("mth09", """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS h, embedding[2]::DOUBLE AS v, abs(embedding[3]::DOUBLE) * 2 AS o FROM embeddings), m AS (SELECT label, median(h) AS uh, median(v) AS uv, median(o) AS lev FROM e GROUP BY 1)
SELECT vec_id, CASE WHEN o < greatest(0.12, 0.65 * lev) THEN 'low_lids' WHEN abs(h - uh) > 0.08 OR abs(v - uv) > 0.10 THEN 'looking_away' ELSE 'eye_contact' END AS state FROM e JOIN m USING (label)""")
def mth09(spark: SparkSession, d: str) -> DataFrame:
    """State of each frame against its clip's own medians."""
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("hv")], (F.abs(F.get("embedding", F.lit(2)).cast("double")) * 2).alias("o"))
    m = e.groupBy("label").agg(F.median("h").alias("uh"), F.median("v").alias("uv"), F.median("o").alias("lev"))
    return e.join(m, "label").select("vec_id", L.gaze_state(*[F.col(c) for c in ("h", "v", "uh", "uv", "o", "lev")]).alias("state"))


@query("mth10")
def mth10(spark: SparkSession, d: str) -> DataFrame:
    """Head pose from six points: a face turned by each row's numbers is projected and its angles found again."""
    c = coords(spark, d)
    yaw, pitch = F.col("v1") * 60, F.col("v2") * 60

    def projected(i: int):
        x, y, z = (float(v) for v in L.FACE_MODEL[i])
        cy, sy, cp, sp = F.cos(F.radians(yaw)), F.sin(F.radians(yaw)), F.cos(F.radians(pitch)), F.sin(F.radians(pitch))
        x1, z1 = cy * x + sy * (-z), -sy * x + cy * (-z)
        y1, z2 = cp * (-y) - sp * z1, sp * (-y) + cp * z1
        depth = z2 + 400.0
        return F.struct((x1 / depth + 0.5).alias("x"), (y1 / depth + 0.5).alias("y"))

    p = c.select("vec_id", L.head_pose(F.array(*[projected(i) for i in range(6)]), F.lit(1.0)).alias("p"))
    return p.select("vec_id", *[F.round(f"p.{a}", 2).alias(a) for a in ("pitch", "yaw", "roll")])


@query("mth11", "SELECT vec_id, CASE WHEN y > 20 THEN 'turned_right' WHEN y < -20 THEN 'turned_left' WHEN p > 20 THEN 'turned_up' WHEN p < -20 THEN 'turned_down' ELSE 'centered' END AS state FROM (SELECT vec_id, embedding[1]::DOUBLE * 150 AS y, embedding[2]::DOUBLE * 150 AS p FROM embeddings)")
def mth11(spark: SparkSession, d: str) -> DataFrame:
    """Head state from its angles."""
    return coords(spark, d).select("vec_id", L.head_state(F.col("v1") * 150, F.col("v2") * 150).alias("state"))


@query("mth12", f"""WITH e AS (SELECT vec_id, {', '.join(f'{x} AS v{i}' for i, x in enumerate(X, 1))} FROM embeddings), w AS (SELECT *, sqrt(pow(v1 - v3, 2) + pow(v2 - v4, 2)) AS mouth, sqrt(pow(v5 - v7, 2) + pow(v6 - v8, 2)) AS face, sqrt(pow(v9 - v11, 2) + pow(v10 - v12, 2)) AS gap FROM e)
SELECT vec_id, CASE WHEN mouth / face > 0.45 AND gap / mouth > 0.05 THEN 'smiling' ELSE 'neutral' END AS state FROM w""")
def mth12(spark: SparkSession, d: str) -> DataFrame:
    """Smile from the mouth's width and openness."""
    used = {61: 0, 291: 1, 33: 2, 263: 3, 13: 4, 14: 5}
    at = lambda i: F.struct(F.col(f"v{used[i] * 2 + 1}").alias("x"), F.col(f"v{used[i] * 2 + 2}").alias("y"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    f = coords(spark, d).select("vec_id", F.array(*[at(i) if i in used else zero for i in range(478)]).alias("face"))
    return f.select("vec_id", L.smile(F.col("face"), F.lit(1.0)).alias("state"))


@query("mth10b")
def mth10b(spark: SparkSession, d: str) -> DataFrame:
    """Pose features of each label: zeros where no frame has a pose."""
    p = mth10(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return p.groupBy("label").agg(zero(F.median("pitch")).alias("pitch"), zero(F.median("yaw")).alias("yaw"), zero(F.stddev_pop("yaw")).alias("yaw_sd"))


