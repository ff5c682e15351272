import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.constants import EFFECT_CHANCES
from quireflow.operators import augment, images as I


def picture(h=120, w=150):
    yy, xx = np.mgrid[0:h, 0:w]
    return np.stack([(xx * 255 / w), (yy * 255 / h), ((xx + yy) % 256)], axis=2).astype(np.uint8)


def test_every_planned_effect_exists():
    assert set(EFFECT_CHANCES) <= set(I.EFFECTS)


@pytest.mark.parametrize("name", sorted(I.EFFECTS))
def test_effects_keep_shape_and_repeat(name):
    x = picture()
    a, b = (I.EFFECTS[name](x.copy(), np.random.default_rng(5)) for _ in range(2))
    assert a.shape == x.shape and a.dtype == np.uint8 and (a == b).all() and (a != x).any()


def test_geometry():
    x = picture()
    assert (I.rotate(x, 0.0) == x).all() and I.rotate(x, 90.0).shape[:2] in ((150, 120), (149, 119), (150, 119), (149, 120))
    assert (I.perspective(x, np.eye(3)) == x).all()
    assert (I.preprocess(x, "none") == x).all() and set(np.unique(I.preprocess(x, "threshold"))) <= {0, 255}
    assert I.preprocess(x, "enhance").shape == x.shape
    with pytest.raises(ValueError):
        I.preprocess(x, "other")


def test_plan_is_applied(spark):
    x = picture()
    rows = spark.createDataFrame([(f"s{i}", x.shape[0], x.shape[1], 3, bytearray(x.tobytes())) for i in range(6)] + [("none", 0, 0, 3, None)], "stem string, height int, width int, n_channels int, data binary")
    planned = rows.join(augment.augment_plan(rows, "stem").select("stem", "effects"), "stem")
    got = {r["stem"]: r["data"] for r in I.apply_effects(planned).collect()}
    again = {r["stem"]: r["data"] for r in I.apply_effects(planned.repartition(3)).collect()}
    assert got == again and got["none"] is None and len({bytes(v) for v in got.values() if v}) > 1
    assert I.apply_effects(rows.withColumn("effects", F.array().cast("array<string>"))).where("stem = 's0'").first()["data"] == x.tobytes()
