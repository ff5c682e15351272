"""Writing results: JSON lines, CSV, label files, dataset layouts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quireflow.functions import text


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """JSON lines; existing output is replaced, or kept with an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def label_lines(labels: DataFrame, crop: str = "crop", label: str = "text") -> DataFrame:
    """Lines `crop<TAB>text` of OCR label files."""
    return labels.select(F.concat_ws("\t", crop, label).alias("value"))


def write_labels(labels: DataFrame, path: str) -> None:
    label_lines(labels).write.mode("overwrite").text(path)


def engine_layout(labels: DataFrame, folder: str = "images/") -> DataFrame:
    """(filename, words) as OCR trainers expect them."""
    return labels.select(F.concat(F.lit(folder), "crop").alias("filename"), F.col("text").alias("words"))


def obb_lines(boxes: DataFrame) -> DataFrame:
    """(split, stem, value): label lines `class x1 y1 .. x4 y4` of boxes(split, stem, class_id, obb)."""
    return boxes.where("obb is not null").select("split", "stem", F.concat_ws(" ", F.col("class_id").cast("string"), text.coordinates(F.col("obb"))).alias("value"))


def write_obb(lines: DataFrame, path: str) -> None:
    """A folder of label lines for each split and stem; stems without boxes get none."""
    lines.repartition("split", "stem").write.mode("overwrite").partitionBy("split", "stem").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows by split, in place of copied files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def dataset_yaml(root: str, names: list[str]) -> str:
    """The descriptor of a detection dataset."""
    lines = [f"path: {root}", *(f"{s}: images/{s}" for s in ("train", "val", "test")), f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {i}: {n}" for i, n in enumerate(names))]) + "\n"


def summary(metrics: DataFrame, title: str = "Evaluation") -> str:
    """A one-row DataFrame as text, a metric to a line."""
    row = metrics.first()
    lines = [title, "=" * len(title)]
    for name, value in (row.asDict() if row else {}).items():
        lines.append(f"{name}: {value:.4f}" if isinstance(value, float) else f"{name}: {value}")
    return "\n".join(lines) + "\n"
