"""Geometry expressions on boxes and polygons. All native.

Boxes of annotations are structs (x, y, width, height); boxes of the engine are structs (x1, y1, x2, y2) of integers,
clipped to the image's pixels; polygons are arrays of structs (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

XYXY = ("x1", "y1", "x2", "y2")
#: Larger than any image: boxes that aren't to be clipped.
UNBOUNDED = 10**9


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("int")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip((x1, y1, x2, y2), XYXY)])


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A box of pixels: rounded, clipped to 0..width-1 and 0..height-1, corners swapped if inverted."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(half_even(v), n.cast("int") - 1))
    a, b, c, d = clip(x1, width), clip(y1, height), clip(x2, width), clip(y2, height)
    return box(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))


def from_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """The engine's box of an annotation's (x, y, width, height)."""
    zero = lambda n: F.coalesce(bbox[n], F.lit(0.0))
    return clipped(zero("x"), zero("y"), zero("x") + zero("width"), zero("y") + zero("height"), width, height)


def hull(polygon: Column) -> Column:
    """The box around a polygon, rounded."""
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return box(half_even(F.array_min(x)), half_even(F.array_min(y)), half_even(F.array_max(x)), half_even(F.array_max(y)))


def hull_bbox(polygon: Column) -> Column:
    """The same as (x, y, width, height), not rounded."""
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))


def annotation_box(bbox: Column, polygon: Column, width: Column, height: Column) -> Column:
    """The engine's box of an annotation that has a bbox, else a polygon, else neither (zeros)."""
    around = hull_bbox(polygon)
    zero = F.lit(0)
    return F.when(bbox.isNotNull(), from_bbox(bbox, width, height)).when(F.size(polygon) > 0, from_bbox(around, width, height)).otherwise(box(zero, zero, zero, zero))


def normalized(b: Column, width: Column, height: Column, scale: int = 1000, truncate: bool = False) -> Column:
    """A box on a scale of 0..1000, half-even or truncated."""
    to = (lambda v: v.cast("int")) if truncate else half_even
    at = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(scale), to(v * scale / F.greatest(n, F.lit(1)))))
    return box(at(b["x1"], width), at(b["y1"], height), at(b["x2"], width), at(b["y2"], height))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]).cast("double") * F.greatest(F.lit(0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w).cast("double") * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x1"] < b["x2"]) & (a["x2"] > b["x1"]) & (a["y1"] < b["y2"]) & (a["y2"] > b["y1"])


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def center_inside(a: Column, b: Column) -> Column:
    """Whether a's centre lies in b, edges included."""
    return center_x(a).between(b["x1"], b["x2"]) & center_y(a).between(b["y1"], b["y2"])


def center_distance(a: Column, b: Column) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def union_agg(b: str) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(F.min(f"{b}.x1").alias("x1"), F.min(f"{b}.y1").alias("y1"), F.max(f"{b}.x2").alias("x2"), F.max(f"{b}.y2").alias("y2"))


def padded_crop(b: Column, padding: int, width: Column, height: Column) -> Column:
    """A box grown on all sides, then clipped."""
    return clipped(b["x1"] - padding, b["y1"] - padding, b["x2"] + padding, b["y2"] + padding, width, height)


def padded_bbox(bbox: Column, padding: int, width: Column, height: Column) -> Column:
    """An annotation's box grown on all sides and cut at the image's edges; (x1, y1, x2, y2) as integers."""
    x1, y1 = F.greatest(F.lit(0), bbox["x"].cast("int") - padding), F.greatest(F.lit(0), bbox["y"].cast("int") - padding)
    x2 = F.least(width.cast("int"), (bbox["x"] + bbox["width"]).cast("int") + padding)
    y2 = F.least(height.cast("int"), (bbox["y"] + bbox["height"]).cast("int") + padding)
    return box(x1, y1, x2, y2)


def padded_bbox_corrected(bbox: Column, padding: int, width: Column, height: Column) -> Column:
    """The variant of corrected annotations: what the left or top edge cuts off is not taken from the width, and the
    padding may be negative. (x, y, width, height) as integers."""
    x, y = F.greatest(F.lit(0), bbox["x"].cast("int") - padding), F.greatest(F.lit(0), bbox["y"].cast("int") - padding)
    w = F.least(width.cast("int") - x, bbox["width"].cast("int") + 2 * padding)
    h = F.least(height.cast("int") - y, bbox["height"].cast("int") + 2 * padding)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def obb_from_vertices(polygon: Column, width: Column, height: Column) -> Column:
    """Eight coordinates within 0..1; null unless the polygon has four complete vertices and the image an area."""
    ok = (F.size(polygon) == 4) & F.forall(polygon, lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (width != 0) & (height != 0)
    return F.when(ok, F.flatten(F.transform(polygon, lambda p: F.array(p["x"] / width, p["y"] / height))))


def corners(bbox: Column) -> Column:
    """Corners of (x, y, width, height): top left, top right, bottom right, bottom left."""
    x, y, r, b = bbox["x"], bbox["y"], bbox["x"] + bbox["width"], bbox["y"] + bbox["height"]
    return F.array(*[F.struct(px.cast("double").alias("x"), py.cast("double").alias("y")) for px, py in ((x, y), (r, y), (r, b), (x, b))])


def obb_from_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """Eight coordinates of a box's corners; null for negative sizes."""
    return F.when((bbox["width"] >= 0) & (bbox["height"] >= 0), obb_from_vertices(corners(bbox), width, height))


def rotation(angle: Column, width: Column, height: Column) -> Column:
    """The affine matrix (a, b, tx, c, d, ty) that turns an image about its centre by an angle in degrees and moves it
    onto the canvas (width, height) that holds it all."""
    t = F.radians(angle)
    cos, sin = F.cos(t), F.sin(t)
    w, h = width.cast("int"), height.cast("int")
    cx, cy = F.floor(w / 2), F.floor(h / 2)
    new_w = (h * F.abs(sin) + w * F.abs(cos)).cast("int")
    new_h = (h * F.abs(cos) + w * F.abs(sin)).cast("int")
    tx = (F.lit(1.0) - cos) * cx - sin * cy + new_w / 2 - cx
    ty = sin * cx + (F.lit(1.0) - cos) * cy + new_h / 2 - cy
    return F.struct(cos.alias("a"), sin.alias("b"), tx.alias("tx"), (-sin).alias("c"), cos.alias("d"), ty.alias("ty"), new_w.alias("width"), new_h.alias("height"))


def affine_point(p: Column, m: Column) -> Column:
    return F.struct((m["a"] * p["x"] + m["b"] * p["y"] + m["tx"]).alias("x"), (m["c"] * p["x"] + m["d"] * p["y"] + m["ty"]).alias("y"))


def onto_canvas(p: Column, width: Column, height: Column) -> Column:
    """A point clipped to the canvas and truncated to pixels."""
    at = lambda v, n: F.greatest(F.lit(0.0), F.least(n.cast("double") - 1, v)).cast("int")
    return F.struct(at(p["x"], width).alias("x"), at(p["y"], height).alias("y"))


def affine_polygon(polygon: Column, m: Column) -> Column:
    """A polygon moved by an affine matrix, clipped to its canvas."""
    return F.transform(polygon, lambda p: onto_canvas(affine_point(p, m), m["width"], m["height"]))


def rotated_polygon(bbox: Column, m: Column) -> Column:
    """The polygon that a box becomes."""
    return affine_polygon(corners(bbox), m)


def rotated_bbox(bbox: Column, m: Column) -> Column:
    """The upright box around what a box becomes, at least one pixel wide and high."""
    moved = F.transform(corners(bbox), lambda p: affine_point(p, m))
    low = lambda n: F.array_min(F.transform(moved, lambda p: p[n]))
    high = lambda n: F.array_max(F.transform(moved, lambda p: p[n]))
    x, y = F.greatest(F.lit(0.0), low("x")), F.greatest(F.lit(0.0), low("y"))
    w = F.greatest(F.lit(1.0), F.least(m["width"] - F.lit(1.0), high("x")) - x)
    h = F.greatest(F.lit(1.0), F.least(m["height"] - F.lit(1.0), high("y")) - y)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def homography_polygon(polygon: Column, matrix: Column, width: Column, height: Column) -> Column:
    """A polygon moved by a 3x3 matrix (an array of nine, row by row), clipped to the canvas."""

    def move(p: Column) -> Column:
        z = matrix[6] * p["x"] + matrix[7] * p["y"] + matrix[8]
        x, y = (matrix[0] * p["x"] + matrix[1] * p["y"] + matrix[2]) / z, (matrix[3] * p["x"] + matrix[4] * p["y"] + matrix[5]) / z
        return onto_canvas(F.struct(x.alias("x"), y.alias("y")), width, height)

    return F.transform(polygon, move)


def solve_homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[float]:
    """The nine entries of the matrix that moves four points onto four others."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, dtype=float), np.array(right, dtype=float)).tolist(), 1.0]


def ordered_corners(polygon: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left, by the sums and differences of coordinates."""
    total, gap = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    by = lambda key, last: F.element_at(F.array_sort(F.transform(polygon, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), -1 if last else 1)
    picked = [by(total, False), by(gap, False), by(total, True), by(gap, True)]
    return F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in picked])


def warp_size(polygon: Column) -> Column:
    """Width and height of the upright image that four ordered corners are warped to: the longer of opposite sides."""
    side = lambda i, j: F.hypot(polygon[i]["x"] - polygon[j]["x"], polygon[i]["y"] - polygon[j]["y"])
    return F.struct(F.greatest(side(2, 3), side(1, 0)).cast("int").alias("width"), F.greatest(side(1, 2), side(0, 3)).cast("int").alias("height"))


def upscale(width: Column, height: Column) -> Column:
    """The factor by which a crop is enlarged for OCR: 2 if it is thin or small, else 1."""
    return F.when((F.least(width, height) < 48) | (F.greatest(width, height) < 160), 2).otherwise(1)


def crop_to_page(b: Column, scale_x: Column, scale_y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A box within an enlarged crop as a box of the page."""
    return clipped(b["x1"] * scale_x + left, b["y1"] * scale_y + top, b["x2"] * scale_x + left, b["y2"] * scale_y + top, width, height)


def scaled_bbox(bbox: Column, sx: Column, sy: Column) -> Column:
    return F.struct((bbox["x"] * sx).alias("x"), (bbox["y"] * sy).alias("y"), (bbox["width"] * sx).alias("width"), (bbox["height"] * sy).alias("height"))


def scaled_polygon(polygon: Column, sx: Column, sy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def repaired_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """A box clamped to the image; null if nothing of it remains."""
    x, y = F.greatest(F.lit(0.0), F.least(bbox["x"], width)), F.greatest(F.lit(0.0), F.least(bbox["y"], height))
    w, h = F.least(bbox["width"], width - x), F.least(bbox["height"], height - y)
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))


def pdf_to_pixels(bbox: Column, dpi: int = 300) -> Column:
    """A box in PDF points as pixels."""
    k = F.lit(dpi / 72.0)
    return scaled_bbox(bbox, k, k)

