"""Schemas of annotation documents and of the tables that models fill."""

from __future__ import annotations

# DDL strings: readers take them as they are, and no session is needed to import them.
BBOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
POLY = "STRUCT<vertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
XYXY = "STRUCT<x1: INT, y1: INT, x2: INT, y2: INT>"

ANNOTATION = (
    f"""version STRING, doc_id STRING, image_path STRING, image_size STRUCT<width: DOUBLE, height: DOUBLE>,
    entities STRUCT<
        ocr_text: ARRAY<STRUCT<id: STRING, text: STRING, bbox: {BBOX}, bounding_poly: {POLY}, direction: STRING, line_id: STRING, confidence: DOUBLE, label: STRING, text_logical: STRING>>,
        `table`: ARRAY<STRUCT<bbox: {BBOX}, bounding_poly: {POLY}, content: ARRAY<ARRAY<STRING>>, confidence: DOUBLE>>,
        kie_fields: ARRAY<STRUCT<label: STRING, normalized_value: STRING, text: STRING, bbox: {BBOX}, token_ids: ARRAY<STRING>>>,
        line_items: ARRAY<STRUCT<item_index: INT, fields: MAP<STRING, STRUCT<text: STRING>>>>>,
    key_information MAP<STRING, STRING>"""
)
DETECTIONS = f"doc STRING, detection_id STRING, bbox {XYXY}, polygon ARRAY<ARRAY<INT>>, confidence DOUBLE, class_id INT, class_name STRING, type STRING"
OCR_TOKENS = f"doc STRING, text STRING, bbox {XYXY}, bbox_norm {XYXY}, ocr_confidence DOUBLE, detection_confidence DOUBLE, detection_id STRING, crop_path STRING"
TOKEN_PREDICTIONS = f"doc STRING, text STRING, bbox {XYXY}, bbox_norm {XYXY}, ocr_confidence DOUBLE, detection_confidence DOUBLE, detection_id STRING, label STRING, label_id INT, lilt_score DOUBLE, token_index INT"
ENTITIES = f"doc STRING, field STRING, text STRING, bbox {XYXY}, bbox_norm {XYXY}, score DOUBLE, token_indices ARRAY<INT>"
RUNS = "doc STRING, timings MAP<STRING, DOUBLE>, gpu_memory_mb DOUBLE"
CATALOG = "Item_Name STRING, Brand STRING, class STRING, Weight STRING, Unit STRING, Pack STRING"
