import numpy as np
import pytest

from gleanstone.functions import landmarks as L
from gleanstone.operators import regression as R
from gleanstone.operators import statistics as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) * [1, 20, 0.1] + [0, 5, 1]
    y = x @ [1.5, 0.1, -4] + rng.normal(size=120)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    rows[7] = (7, None, *rows[7][2:])
    return rows, spark.createDataFrame(rows, "id int, a double, b double, c double, y double")


def design(rows):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    return (x - x.mean(0)) / x.std(0), np.array([r[4] for r in rows])


def test_ridge_equals_the_closed_form(data):
    rows, df = data
    z, y = design(rows)
    m = R.fit(df, "id", ["a", "b", "c"], "y", 3.0)
    want = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coef, want, atol=1e-9) and abs(m.intercept - y.mean()) < 1e-9
    got = {r["id"]: r["p"] for r in df.select("id", m.predict().alias("p")).collect()}
    assert np.allclose([got[i] for i in range(120)], z @ want + y.mean(), atol=1e-8)
    assert df.where("id = 7").select(m.predict(True).alias("p")).first()["p"] is None


def test_leave_one_out_choice(data):
    rows, df = data
    z, y = design(rows)

    def loo(a):
        e = 0.0
        for i in range(len(y)):
            k = np.arange(len(y)) != i
            zc, yc = z[k], y[k]
            mz, my = zc.mean(0), yc.mean()
            b = np.linalg.solve((zc - mz).T @ (zc - mz) + a * np.eye(3), (zc - mz).T @ (yc - my))
            e += (y[i] - my - (z[i] - mz) @ b) ** 2
        return e

    alphas = [0.01, 1.0, 30.0, 1000.0]
    p = R.prepare(df, "id", ["a", "b", "c"], "y")
    assert R.loo_alpha(p, R.grams(p.rows, 3)[0], alphas) == min(alphas, key=loo)


def test_folds_leave_their_rows_out(data):
    rows, df = data
    o = R.out_of_fold(df, "id", ["a", "b", "c"], "y", 4, 2)
    got = o.collect()
    assert len(got) == 240 and all(r["pred"] is not None for r in got)
    assert S.spearman(o, ["repeat"], "pred", "y").first()["rho"] > 0.5
    assert R.fit(df.where("id < 3"), "id", ["a"], "y") is None


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")], "x string, y string")
    r = S.cohen(df, "x", "y").first()
    assert r["n"] == 50 and abs(r["agree"] - 0.7) < 1e-12 and abs(r["kappa"] - 0.4) < 1e-12
    assert S.cohen(spark.createDataFrame([("a", "a")], "x string, y string"), "x", "y").first()["kappa"] is None


def test_pose_is_found_again():
    for yaw, pitch in ((0, 0), (25, 0), (-30, 10), (5, -25)):
        a, b = np.radians(yaw), np.radians(pitch)
        ry = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
        rx = np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
        p = (L.FACE_MODEL * [1, -1, -1]) @ (ry @ rx).T + [0, 0, 400]
        got = L.solve_pose(p[:, :2] / p[:, 2:] + [0.5, 0.5], 1.0)
        assert abs(got[1] - yaw) < 0.1 and abs(got[0] - pitch) < 0.1 and abs(got[2]) < 0.5, (got, yaw, pitch)
    assert L.solve_pose(np.full((6, 2), np.nan), 1.0) is None
