"""Reading annotation documents, images, catalogs and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow import schemas
from quireflow.constants import IMAGE_SUFFIXES, SUFFIX_PRIORITY
from quireflow.functions import text


def read_annotations(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per JSON document, with `stem` and `path`; what doesn't parse has _corrupt_record and nulls."""
    reader = spark.read.schema(schemas.ANNOTATION + ", _corrupt_record STRING")
    reader = reader.option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive)
    return with_source(reader.json(path))


def with_source(df: DataFrame) -> DataFrame:
    return df.select(text.stem(F.col("_metadata.file_name")).alias("stem"), F.col("_metadata.file_path").alias("path"), "*")


def split_valid(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that parse and have an image size, and the others with the reason."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), "not JSON of the schema").when(F.col("image_size.width").isNull() | F.col("image_size.height").isNull(), "no image size").when((F.col("image_size.width") <= 0) | (F.col("image_size.height") <= 0), "image without area").when(F.col("entities").isNull(), "no entities")
    seen = annotations.withColumn("reason", reason)
    return seen.where("reason is null").drop("reason", "_corrupt_record"), seen.where("reason is not null")


def latest(annotations: DataFrame, order: str = "path") -> DataFrame:
    """One row per stem: of several the last by `order`."""
    last = Window.partitionBy("stem").orderBy(F.col(order).desc())
    return annotations.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def list_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recursive: bool = False) -> DataFrame:
    """(stem, suffix, path, length) of image files. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    return files.select(text.stem(F.col("path")).alias("stem"), text.suffix(F.col("path")).alias("suffix"), "path", "length").where(F.col("suffix").isin(*suffixes))


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """(stem, width, height, n_channels, data) of images; such that can't be decoded are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return image.select(text.stem(F.col("origin")).alias("stem"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


def pick_by_suffix(images: DataFrame, priority: tuple[str, ...] = SUFFIX_PRIORITY) -> DataFrame:
    """One image per stem: the suffix that comes first in `priority`; others are left out."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("suffix"))
    first = Window.partitionBy("stem").orderBy("_p", "path")
    return images.withColumn("_p", rank).where("_p > 0").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_p", "_r")


def pick_png_first(images: DataFrame) -> DataFrame:
    """One image per stem: .png, else the first by path."""
    first = Window.partitionBy("stem").orderBy(F.col("suffix") != ".png", "path")
    return images.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows (name, brand, category, weight, unit, pack) whose name holds Arabic."""
    rows = spark.read.schema(schemas.CATALOG).option("header", True).csv(path)
    return catalog(rows)


def catalog(rows: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.where(text.is_arabic(F.col("Item_Name"))).select(F.col("Item_Name").alias("name"), F.col("Brand").alias("brand"), F.col("class").alias("category"), empty("Weight").alias("weight"), empty("Unit").alias("unit"), empty("Pack").alias("pack"))


def label_parts(line: Column) -> Column:
    return F.split(F.trim(line), "\t")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(crop, text) of tab-separated label files; lines of other than two columns are left out."""
    return labels(spark.read.text(path))


def labels(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = label_parts(F.col(column))
    return lines.where(F.size(parts) == 2).select(parts[0].alias("crop"), parts[1].alias("text"))


def tokens(annotations: DataFrame) -> DataFrame:
    """(stem, pos, width, height, id, text, bbox, bounding_poly, direction, line_id, confidence, label) of text entities."""
    size = [F.coalesce(F.col(f"image_size.{n}"), F.lit(1.0)).alias(n) for n in ("width", "height")]
    return annotations.select("stem", *size, F.posexplode("entities.ocr_text").alias("pos", "t")).select("stem", "pos", "width", "height", "t.*")


def tables(annotations: DataFrame) -> DataFrame:
    """(stem, pos, width, height, bbox, bounding_poly, content, confidence) of table entities."""
    size = [F.coalesce(F.col(f"image_size.{n}"), F.lit(1.0)).alias(n) for n in ("width", "height")]
    return annotations.select("stem", *size, F.posexplode("entities.table").alias("pos", "t")).select("stem", "pos", "width", "height", "t.*")


def kie_fields(annotations: DataFrame) -> DataFrame:
    """(stem, pos, label, value, bbox, token_ids) of fields with a label: the normalised value, else the text. A null
    normalised value counts as absent."""
    fields = annotations.select("stem", F.posexplode("entities.kie_fields").alias("pos", "f")).where(F.length("f.label") > 0)
    return fields.select("stem", "pos", "f.label", F.coalesce("f.normalized_value", "f.text", F.lit("")).alias("value"), "f.bbox", F.coalesce("f.token_ids", F.array().cast("array<string>")).alias("token_ids"))


def line_items(annotations: DataFrame) -> DataFrame:
    """(stem, item_index, label, text) of line items."""
    items = annotations.select("stem", F.explode("entities.line_items").alias("i"))
    return items.select("stem", "i.item_index", F.explode("i.fields").alias("label", "payload")).select("stem", "item_index", "label", F.coalesce("payload.text", F.lit("")).alias("text"))
