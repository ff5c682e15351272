"""The page pipeline around the models: what models give is cleaned, ordered, merged and mapped to fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.constants import MIN_OCR_CONFIDENCE
from quireflow.functions import geometry as G
from quireflow.operators import matching, metrics, ordering, pairing
from quireflow.sources import annotations as A


def ground_truth_tokens(annotations: DataFrame) -> DataFrame:
    """(stem, pos, id, text, bbox, bbox_norm, direction, line_id, reading_order): tokens in reading order from the
    right, boxes before polygons."""
    box = G.annotation_box(F.col("bbox"), F.col("bounding_poly.vertices"), F.col("width"), F.col("height"))
    rows = A.tokens(annotations).withColumn("bbox", box).withColumn("bbox_norm", G.normalized(F.col("bbox"), F.col("width"), F.col("height")))
    return ordering.line_order(rows.select("stem", "pos", "id", F.coalesce("text", F.lit("")).alias("text"), "bbox", "bbox_norm", "direction", "line_id"))


def ground_truth_labels(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """tokens with token_label: B- on a field's first token that is known, I- on the others, O on tokens of no mapped
    field; of fields that claim one token the last one wins."""
    mapped = pairing.to_model_labels(fields).select("stem", F.col("pos").alias("_f"), "model_label", F.posexplode("token_ids").alias("_i", "id"))
    known = metrics.last_wins(tokens, ["stem", "id"], "reading_order").where("id is not null").select("stem", "id", F.col("pos").alias("_pos"))
    met = mapped.join(known, ["stem", "id"])
    met = ordering.ranked(met, "_n", ["stem", "_f"], ["_i"])
    tags = met.withColumn("token_label", F.concat(F.when(F.col("_n") == 0, "B-").otherwise("I-"), "model_label")).withColumn("_w", F.struct("_f", "_n"))
    last = metrics.last_wins(tags, ["stem", "_pos"], "_w").select("stem", F.col("_pos").alias("pos"), "token_label")
    return tokens.join(last, ["stem", "pos"], "left").withColumn("token_label", F.coalesce("token_label", F.lit("O")))


def ground_truth_fields(annotations: DataFrame) -> DataFrame:
    """(stem, label, value, bbox): fields, of one label the last."""
    return metrics.last_wins(A.kie_fields(annotations), ["stem", "label"], "pos").select("stem", "label", "value", "bbox")


def clean_tokens(tokens: DataFrame, key: str = "doc", direction: str = "rtl", unicode: bool = True) -> DataFrame:
    """OCR tokens of enough confidence, split into words, without duplicates, in reading order."""
    sure = tokens.where(F.col("ocr_confidence") >= MIN_OCR_CONFIDENCE)
    words = ordering.split_boxes(sure, unicode=unicode).withColumn("text", F.col("piece")).withColumn("bbox", F.col("piece_box"))
    words = ordering.ranked(words, "_p", [key], ["pos", "piece_no"]).withColumn("pos", F.col("_p").cast("long")).drop("_p", "piece", "piece_box", "piece_no")
    return ordering.line_order(ordering.dedup_tokens(words, key, unicode=unicode), key, direction=direction)


def entities(predictions: DataFrame, key: str = "doc") -> DataFrame:
    """Entities of token predictions (label, lilt_score, bbox, bbox_norm, token_index)."""
    return ordering.merge_entities(ordering.tag_runs(predictions, [key], ["token_index"]), [key], "token_index", score="lilt_score", boxes=("bbox", "bbox_norm"))


def field_values(found: DataFrame, key: str = "doc") -> DataFrame:
    """(key, gt_field, text, score): the best candidate of each annotation field."""
    return metrics.best_candidates(pairing.to_annotation_fields(found), [key, "gt_field"], "score", "entity").select(key, "gt_field", "text", "score")


def ocr_texts(tokens: DataFrame, fields: DataFrame, key: str = "doc", direction: str = "rtl") -> DataFrame:
    """(key, label, text): what OCR read within each field's box, in reading order."""
    met = matching.tokens_in_fields(tokens, fields, key)
    met = met.withColumn("_page", F.concat_ws("\u0001", key, "label"))
    ordered = ordering.line_order(met, "_page", direction=direction)
    return metrics.document_text(ordered, [key, "label"], "reading_order")


def argmax_label(scores: DataFrame, logits: str = "logits") -> DataFrame:
    """scores with label_id and lilt_score: the most probable class of an array of logits and its softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return scores.withColumn("label_id", (F.array_position(logits, top) - 1).cast("int")).withColumn("lilt_score", F.lit(1.0) / total)


def with_fallback(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the first recogniser, and of the second for crops that the first gave nothing for."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))
