import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quireflow.functions import geometry as G


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(*v):
    return G.box(*[F.lit(x) for x in v])


def ann(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "width", "height"), (x, y, w, h))])


def test_rounding_and_clipping(spark):
    assert list(one(spark, G.half_even(F.lit(2.5)), G.half_even(F.lit(3.5)))) == [2, 4]
    r = one(spark, G.clipped(*[F.lit(v) for v in (9.0, 9.0, 1.0, 1.0)], F.lit(20), F.lit(20)).alias("b"))["b"]
    assert tuple(r) == (1, 1, 9, 9)


def test_iou(spark):
    r = one(spark, G.iou(box(0, 0, 10, 10), box(0, 5, 10, 15)), G.iou(box(3, 3, 3, 3), box(3, 3, 3, 3)))
    assert r[0] == 50 / 150 and r[1] == 0.0


coordinate = st.integers(0, 30)


@settings(max_examples=15, deadline=None)
@given(st.tuples(*[coordinate] * 8))
def test_iou_is_symmetric(spark, v):
    a, b = box(*v[:4]), box(*v[4:])
    x, y = one(spark, G.iou(a, b), G.iou(b, a))
    assert x == y and 0 <= x <= 1


def test_padding_variants(spark):
    r = one(spark, G.padded_bbox(ann(2, 2, 10, 10), 5, F.lit(100), F.lit(100)).alias("a"), G.padded_bbox_corrected(ann(2, 2, 10, 10), 5, F.lit(100), F.lit(100)).alias("b"))
    assert tuple(r["a"]) == (0, 0, 17, 17)
    assert tuple(r["b"]) == (0, 0, 20, 20)


def test_obb(spark):
    r = one(spark, G.obb_from_bbox(ann(10, 20, 30, 40), F.lit(100), F.lit(200)).alias("o"), G.obb_from_bbox(ann(1, 1, -1, 1), F.lit(9), F.lit(9)).alias("n"), G.obb_from_vertices(G.corners(ann(0, 0, 1, 1)), F.lit(0), F.lit(5)).alias("z"))
    assert [round(v, 6) for v in r["o"]] == [0.1, 0.1, 0.4, 0.1, 0.4, 0.3, 0.1, 0.3]
    assert r["n"] is None and r["z"] is None


def test_rotation_by_zero_and_ninety(spark):
    r = one(spark, G.rotated_polygon(ann(10, 20, 30, 40), G.rotation(F.lit(0.0), F.lit(100), F.lit(200))).alias("p"), G.rotation(F.lit(90.0), F.lit(100), F.lit(200)).alias("m"))
    assert [tuple(p) for p in r["p"]] == [(10, 20), (40, 20), (40, 60), (10, 60)]
    assert math.isclose(r["m"]["width"], 200, abs_tol=1) and math.isclose(r["m"]["height"], 100, abs_tol=1)


def test_homography(spark):
    source, target = [(0, 0), (100, 0), (100, 50), (0, 50)], [(3, 2), (98, 1), (99, 48), (1, 49)]
    m = G.solve_homography(source, target)
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in source])
    moved = one(spark, G.homography_polygon(poly, F.array(*map(F.lit, m)), F.lit(200), F.lit(200)).alias("p"))["p"]
    for p, (x, y) in zip(moved, target):
        assert abs(p["x"] - x) <= 1 and abs(p["y"] - y) <= 1


def test_corners_and_warp(spark):
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.0, 8.0), (0.0, 0.0), (0.0, 8.0), (9.0, 0.0))])
    r = one(spark, G.ordered_corners(poly).alias("c"), G.warp_size(G.ordered_corners(poly)).alias("s"), G.upscale(F.lit(200), F.lit(40)).alias("u"))
    assert [tuple(p) for p in r["c"]] == [(0.0, 0.0), (9.0, 0.0), (9.0, 8.0), (0.0, 8.0)]
    assert tuple(r["s"]) == (9, 8) and r["u"] == 2


def test_annotation_box_precedence(spark):
    poly = G.corners(ann(1, 2, 3, 4))
    none = F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
    r = one(spark, G.annotation_box(none, poly, F.lit(50), F.lit(50)).alias("p"), G.annotation_box(ann(5, 5, 5, 5), poly, F.lit(50), F.lit(50)).alias("b"), G.annotation_box(none, F.lit(None).cast("array<struct<x:double,y:double>>"), F.lit(50), F.lit(50)).alias("z"))
    assert tuple(r["p"]) == (1, 2, 4, 6) and tuple(r["b"]) == (5, 5, 10, 10) and tuple(r["z"]) == (0, 0, 0, 0)
    assert one(spark, G.repaired_bbox(ann(-5, 0, 20, 20), F.lit(10.0), F.lit(10.0)).alias("r"), G.repaired_bbox(ann(20, 0, 5, 5), F.lit(10.0), F.lit(10.0)).alias("n"))["n"] is None
