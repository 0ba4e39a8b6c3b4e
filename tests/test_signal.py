import numpy as np
import pytest

from gleanstone.functions.signal import measure
from gleanstone.operators.guards import assert_disjoint, without_leaks


@pytest.mark.parametrize("hz", [100, 180, 310])
def test_pitch_and_silence(hz):
    tone = 0.1 * np.sin(2 * np.pi * hz * np.arange(8000) / 8000)
    pitch, sd, db, silent = measure(np.concatenate([tone, np.zeros(8000)]), 8000)
    assert abs(pitch - hz) < 0.03 * hz and sd < 5 and 60 < db < 80 and abs(silent - 0.5) < 0.05
    assert measure(np.zeros(8000), 8000) == (None, None, None, 1.0)
    assert measure(np.zeros(0), 8000)[3] == 1.0


def test_guards(spark):
    a, b = spark.range(10), spark.range(8, 12)
    assert without_leaks(a, b, "id").count() == 8
    with pytest.raises(ValueError):
        assert_disjoint(a, b, "id")
    assert_disjoint(a, spark.range(20, 22), "id")
