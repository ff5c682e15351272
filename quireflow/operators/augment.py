"""What augmentation decides and what it does to annotations; pixels stay outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.constants import EFFECT_CHANCES, MAX_SIDE, PERSPECTIVE_CHANCE, PERSPECTIVE_DECAY, ROTATION_CHANCE, ROTATION_DECAY
from quireflow.functions import geometry as G
from quireflow.operators.generate import uniform


def unit(seed: int, key: Column, purpose: str) -> Column:
    """A number in [0, 1) with four decimals out of an MD5: anybody can compute it again, in SQL too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(purpose)).cast("binary")), 1, 7), 16, 10).cast("long") % 10000 / 10000.0


def effects(seed: int, key: Column) -> Column:
    """Names of the effects that fire, in the order they are applied."""
    return F.filter(F.array(*[F.when(unit(seed, key, name) < chance, name) for name, chance in EFFECT_CHANCES.items()]), lambda e: e.isNotNull())


def branch(seed: int, key: Column) -> Column:
    """perspective, rotation or none."""
    return F.when(unit(seed, key, "perspective") < PERSPECTIVE_CHANCE, "perspective").when(unit(seed, key, "rotation") < ROTATION_CHANCE, "rotation").otherwise("none")


def angle(seed: int, key: Column) -> Column:
    return unit(seed, key, "angle") * 14.0 - 7.0


def augment_plan(docs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, effects, geometry, angle, output_name)."""
    k = F.col(key)
    return docs.select(key, effects(seed, k).alias("effects"), branch(seed, k).alias("geometry"), angle(seed, k).alias("angle"), F.concat(F.lit("augmented_"), k.cast("string"), F.lit(".jpg")).alias("output_name"))


def decay(geometry: Column) -> Column:
    return F.when(geometry == "perspective", PERSPECTIVE_DECAY).when(geometry == "rotation", ROTATION_DECAY).otherwise(1.0)


def fit_scale(width: Column, height: Column, most: int = MAX_SIDE) -> Column:
    """The factor that brings the longer side down to `most` pixels; 1 if it is short enough."""
    return F.when(F.greatest(width, height) > most, F.lit(float(most)) / F.greatest(width, height)).otherwise(1.0)


def homography_targets(seed: int, key: Column, width: Column, height: Column, share: float = 0.03) -> Column:
    """Where the four corners of an image go: each moved inwards by up to `share` of the sides."""
    move = lambda side, n: uniform(seed, key, n) * side * share
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(move(width, "x0"), move(height, "y0")), point(width - move(width, "x1"), move(height, "y1")), point(width - move(width, "x2"), height - move(height, "y2")), point(move(width, "x3"), height - move(height, "y3")))


def rescale(annotations: DataFrame) -> DataFrame:
    """Annotations of images that are too large, scaled down with all of their boxes and polygons."""
    s = F.col("_s")

    def entity(e: Column) -> Column:
        poly = F.when(e["bounding_poly"].isNotNull(), F.struct(G.scaled_polygon(e["bounding_poly"]["vertices"], s, s).alias("vertices")))
        return e.withField("bbox", F.when(e["bbox"].isNotNull(), G.scaled_bbox(e["bbox"], s, s))).withField("bounding_poly", poly)

    out = annotations.withColumn("_s", fit_scale(F.col("image_size.width"), F.col("image_size.height")))
    out = out.withColumn("entities", F.col("entities").withField("ocr_text", F.transform("entities.ocr_text", entity)).withField("table", F.transform("entities.table", entity)))
    return out.withColumn("image_size", F.struct((F.col("image_size.width") * s).cast("int").cast("double").alias("width"), (F.col("image_size.height") * s).cast("int").cast("double").alias("height"))).drop("_s")


def rotate(annotations: DataFrame, angle_: Column) -> DataFrame:
    """Annotations after a rotation: boxes become polygons, the image its new canvas, texts lose confidence; tables
    keep theirs."""
    out = annotations.withColumn("_m", G.rotation(angle_, F.col("image_size.width"), F.col("image_size.height")))
    m = F.col("_m")
    as_double = lambda poly: F.transform(poly, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))

    def entity(e: Column, share: float) -> Column:
        old = F.when(e["bbox"].isNotNull(), G.corners(e["bbox"])).otherwise(e["bounding_poly"]["vertices"])
        moved = F.when(old.isNotNull(), F.struct(as_double(G.affine_polygon(old, m)).alias("vertices")))
        return e.withField("bounding_poly", moved).withField("bbox", F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")).withField("confidence", e["confidence"] * share)

    out = out.withColumn("entities", F.col("entities").withField("ocr_text", F.transform("entities.ocr_text", lambda e: entity(e, ROTATION_DECAY))).withField("table", F.transform("entities.table", lambda e: entity(e, 1.0))))
    return out.withColumn("image_size", F.struct(F.col("_m.width").cast("double").alias("width"), F.col("_m.height").cast("double").alias("height"))).drop("_m")
