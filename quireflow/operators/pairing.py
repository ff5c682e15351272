"""Pairing images with annotations and splitting datasets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow.constants import MODEL_LABELS, SPLIT_SEED, SPLITS

#: Buckets of the hash order of a split: the largest sorts that one task does are rows / BUCKETS.
BUCKETS = 4096


def pair(images: DataFrame, annotations: DataFrame, on: str = "stem") -> DataFrame:
    """Images with their annotations."""
    return images.join(annotations, on)


def unmatched(images: DataFrame, annotations: DataFrame, on: str = "stem") -> DataFrame:
    """Images without an annotation."""
    return images.join(annotations, on, "left_anti")


def with_truth(images: DataFrame, annotations: DataFrame, on: str = "stem") -> DataFrame:
    """Images that have an annotation, themselves only."""
    return images.join(annotations, on, "left_semi")


def with_optional(rows: DataFrame, more: DataFrame, on: str = "stem") -> DataFrame:
    """Every row, with what is known of it."""
    return rows.join(more, on, "left")


def crops_with_labels(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops (path) with the label line of the same file name."""
    return crops.withColumn("crop", F.element_at(F.split("path", "/"), -1)).join(labels, "crop")


def field_map(spark: SparkSession) -> DataFrame:
    """(gt_field, model_label): a fixed dimension of a few dozen rows."""
    rows = [F.struct(F.lit(f).alias("gt_field"), F.lit(label).alias("model_label")) for f, label in MODEL_LABELS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def to_model_labels(fields: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Fields (label) with their model_label; such without one are dropped."""
    mapping = F.broadcast(field_map(fields.sparkSession)) if mapping is None else mapping
    return fields.join(mapping, fields["label"] == mapping["gt_field"]).drop("gt_field")


def to_annotation_fields(entities: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Entities (field: a model label) as candidates (gt_field): one row to each annotation field of the label, and
    the lower-cased label itself where no field is known."""
    mapping = F.broadcast(field_map(entities.sparkSession)) if mapping is None else mapping
    return entities.join(mapping, entities["field"] == mapping["model_label"], "left").withColumn("gt_field", F.coalesce("gt_field", F.lower("field"))).drop("model_label")


def hash_order(key: Column, seed: int = SPLIT_SEED) -> Column:
    """A row's place in the seeded shuffle: the same in every run, whatever the order of the input."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def split(rows: DataFrame, key: str = "stem", shares: dict[str, str] | None = None, seed: int = SPLIT_SEED) -> DataFrame:
    """rows with `split`, exact in size: rows in hash order, the first ones to the first split. A split has the whole
    part of its share of all rows, the last one what is left over; shares that don't sum to 1 are scaled.

    The rank is a bucket's start plus the rank within it, so no task sorts all rows. Equal keys are ordered by the
    rest of the row's hash; a null key takes part.
    """
    shares = shares or SPLITS
    order = rows.withColumn("_order", hash_order(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    # at most BUCKETS rows: their running sums are one small task's work, and they are broadcast within that bound
    counts = order.groupBy("_bucket").agg(F.count("*").alias("_c"))
    w = Window.orderBy("_bucket")
    starts = counts.select("_bucket", (F.sum("_c").over(w) - F.col("_c")).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    met = order.join(F.broadcast(starts), "_bucket").withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key)))
    scale, end, label = sum(map(Decimal, shares.values())), F.lit(0).cast("long"), None
    *first, last = shares.items()
    for name, share in first:
        end = end + F.floor(F.col("_total").cast("decimal(18,0)") * F.lit(Decimal(share) / scale).cast("decimal(18,12)")).cast("long")
        label = F.when(F.col("_rank") <= end, name) if label is None else label.when(F.col("_rank") <= end, name)
    return met.withColumn("split", label.otherwise(last[0]) if label is not None else F.lit(last[0])).drop("_order", "_bucket", "_start", "_total", "_rank")


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def sample(rows: DataFrame, k: int, key: str = "stem", seed: int = SPLIT_SEED) -> DataFrame:
    """k rows, the first ones in hash order."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(k)


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of all parts with `part`, the part's number from 0."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
