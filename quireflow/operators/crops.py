"""Training sets of crops and detection labels out of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quireflow.functions import geometry as G, text
from quireflow.sources import annotations as A


def crop_set(tokens: DataFrame, padding: int = 5) -> DataFrame:
    """(stem, crop_index, crop, text, box): crops of tokens with a text, padded and cut at the image's edges; such
    without area are left out and don't count. Polygons go before boxes."""
    poly = F.col("bounding_poly.vertices")
    around = F.when(F.size(poly) > 0, G.hull_bbox(poly)).otherwise(F.col("bbox"))
    rows = tokens.where((F.length(F.trim("text")) > 0)).withColumn("_b", around).where("_b is not null").withColumn("box", G.padded_bbox(F.col("_b"), padding, F.col("width"), F.col("height")))
    rows = rows.where("box.x2 > box.x1 and box.y2 > box.y1")
    n = F.row_number().over(Window.partitionBy("stem").orderBy("pos")) - 1
    return rows.withColumn("crop_index", n).select("stem", "crop_index", F.concat_ws("_", "stem", F.col("crop_index").cast("string")).alias("_c"), "text", "box").withColumn("crop", F.concat("_c", F.lit(".png"))).drop("_c")


def crop_set_corrected(tokens: DataFrame, padding: int = 0, min_width: int = 10, min_height: int = 10) -> DataFrame:
    """The variant of corrected annotations: boxes only, a least size, and the token's own number in the name."""
    ok = (F.length(F.trim("text")) > 0) & F.col("bbox.x").isNotNull() & F.col("bbox.y").isNotNull() & F.col("bbox.width").isNotNull() & F.col("bbox.height").isNotNull()
    rows = tokens.where(ok).withColumn("box", G.padded_bbox_corrected(F.col("bbox"), padding, F.col("width"), F.col("height"))).where((F.col("box.width") >= min_width) & (F.col("box.height") >= min_height))
    return rows.select("stem", F.col("pos").alias("crop_index"), F.concat(F.col("stem"), F.lit("_"), F.col("pos").cast("string"), F.lit(".png")).alias("crop"), "text", "box")


def preparation_stats(tokens: DataFrame, crops: DataFrame) -> DataFrame:
    """One row: images, regions, valid and skipped ones."""
    seen = tokens.agg(F.countDistinct("stem").alias("images"), F.count("*").alias("regions"))
    return seen.crossJoin(crops.agg(F.count("*").alias("valid"))).withColumn("skipped", F.col("regions") - F.col("valid"))


def entity_obb(entities: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """(stem, class_id, obb, reason) of text (class 0) or table (class 1) entities. strict: polygons only of texts,
    boxes only of tables; else either, polygons first. What has neither gives a reason instead of an obb."""
    poly = G.obb_from_vertices(F.col("bounding_poly.vertices"), F.col("width"), F.col("height"))
    box = G.obb_from_bbox(F.col("bbox"), F.col("width"), F.col("height"))
    obb = (poly if kind == "text" else box) if strict else F.coalesce(poly, box)
    return entities.select("stem", F.lit(0 if kind == "text" else 1).alias("class_id"), obb.alias("obb")).withColumn("reason", F.when(F.col("obb").isNull(), "no usable box"))


def detection_labels(annotations: DataFrame, splits: DataFrame, strict: bool = False) -> DataFrame:
    """(split, stem, class_id, obb): labels of all entities of annotations, texts before tables, by splits(stem, split)."""
    both = entity_obb(A.tokens(annotations), "text", strict).unionByName(entity_obb(A.tables(annotations), "table", strict))
    return both.where("obb is not null").join(splits.select("stem", "split"), "stem").select("split", "stem", "class_id", "obb")


def overlay_boxes(tokens: DataFrame, length: int = 20) -> DataFrame:
    """(stem, pos, box, label): what a viewer draws of each token; boxes go before polygons, long labels are cut."""
    box = G.annotation_box(F.col("bbox"), F.col("bounding_poly.vertices"), F.col("width"), F.col("height"))
    return tokens.select("stem", "pos", box.alias("box"), text.truncate(F.coalesce("text", F.lit("")), length).alias("label"))


def text_regions(regions: DataFrame, name: str = "text") -> DataFrame:
    return regions.where(F.col("class_name") == name)
