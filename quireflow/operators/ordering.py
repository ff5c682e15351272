"""Reading order, numbering, and runs of tags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from quireflow.constants import DEDUP_IOU, LINE_SHARE, LINE_TOLERANCE, READING_BUCKET
from quireflow.functions import geometry as G, text
from quireflow.operators.grouped import Arrays, map_groups


def _lines(y: np.ndarray, x: np.ndarray, tolerance: float, rtl: bool) -> np.ndarray:
    """Places of items in reading order. Items come by height; each joins the first line whose running mean is near
    enough, or opens one. Lines are read from the top, items within from the right or the left."""
    at = np.lexsort((np.arange(len(y)), x, y))
    means, members = [], []
    for i in at.tolist():
        for k, mean in enumerate(means):
            if abs(y[i] - mean) <= tolerance:
                members[k].append(i)
                means[k] = float(np.mean(y[members[k]]))
                break
        else:
            means.append(float(y[i]))
            members.append([i])
    out = []
    for k in sorted(range(len(means)), key=means.__getitem__):
        own = members[k]
        out += sorted(own, key=lambda i: x[i], reverse=rtl)
    rank = np.empty(len(y), dtype=np.int64)
    rank[out] = np.arange(len(y))
    return rank


def line_order(items: DataFrame, key: str = "stem", box: str = "bbox", pos: str = "pos", direction: str = "rtl", tolerance: int | None = None) -> DataFrame:
    """items with `reading_order` from 0 within each document.

    Lines form greedily around running means, which depends on the order of arrival: a grouped function on ids and
    boxes alone does it, a page at a time, and the result joins the items again.
    """

    def run(page: Arrays) -> Arrays:
        height = np.maximum(1, page["y2"] - page["y1"])
        near = max(LINE_TOLERANCE, int(np.median(height) * LINE_SHARE)) if tolerance is None else tolerance
        rank = _lines((page["y1"] + page["y2"]) / 2, (page["x1"] + page["x2"]) / 2, near, direction == "rtl")
        return {pos: page["p"], "reading_order": rank}

    kinds = dict(items.dtypes)
    small = items.select(key, F.col(pos).cast("long").alias("p"), *[F.col(f"{box}.{n}").cast("double").alias(n) for n in G.XYXY])
    ordered = map_groups(small, [key], ["p"], run, {pos: "int64", "reading_order": "int64"}, f"{key} {kinds[key]}, {pos} long, reading_order long")
    return items.join(ordered.withColumn(pos, F.col(pos).cast(kinds[pos])), [key, pos])


def line_tolerance(items: DataFrame, key: str = "stem", box: str = "bbox") -> DataFrame:
    """(key, tolerance): the greatest distance from a line's mean on each page."""
    height = F.greatest(F.lit(1), F.col(f"{box}.y2") - F.col(f"{box}.y1"))
    return items.groupBy(key).agg(F.greatest(F.lit(LINE_TOLERANCE), (F.median(height) * LINE_SHARE).cast("int")).alias("tolerance"))


def ranked(df: DataFrame, name: str, by: list, order: list) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def bucket_order(items: DataFrame, key: str, y: Column, x: Column, pos: str, bucket: int = READING_BUCKET) -> DataFrame:
    """Reading order by rows of fixed height, from the right within a row."""
    return ranked(items, "reading_order", [key], [F.floor(y / bucket), x.desc(), F.col(pos)])


def strict_order(items: DataFrame, key: str, y: Column, x: Column, pos: str) -> DataFrame:
    """Reading order by exact height, from the right at equal height."""
    return ranked(items, "reading_order", [key], [y, x.desc(), F.col(pos)])


def prefix_of(label: Column) -> Column:
    return F.when(F.instr(label, "-") > 0, F.substring_index(label, "-", 1)).otherwise(F.lit(""))


def tag_runs(tokens: DataFrame, key: list[str], order: list[str], label: str = "label") -> DataFrame:
    """Tokens that belong to an entity, with `field` and `entity`, the entity's number in its document from 1.

    A B tag opens an entity; any other tag goes on with the open entity if that has the same field, else opens one;
    O closes it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    own = F.when(F.col(label) != "O", text.field_of(F.col(label)))
    seen = tokens.withColumn("field", own).withColumn("_before", F.lag("field").over(w))
    opens = F.col("field").isNotNull() & ((prefix_of(F.col(label)) == "B") | F.col("_before").isNull() | (F.col("_before") != F.col("field")))
    return seen.withColumn("entity", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("field is not null").drop("_before")


def tag_runs_strict(tokens: DataFrame, key: list[str], order: list[str], label: str = "label") -> DataFrame:
    """The variant in which tags other than O, B-.. and I-.. are passed over and leave the entity open."""
    return tag_runs(tokens.where((F.col(label) == "O") | F.col(label).rlike("^[BI]-")), key, order, label)


def merge_entities(runs: DataFrame, key: list[str], order: str, word: str = "text", score: str | None = None, boxes: tuple[str, ...] = ()) -> DataFrame:
    """One row to each entity of tag_runs(): text, token indices, mean score, boxes around all of its tokens."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w"))))
    more = [F.avg(score).alias("score")] if score else []
    more += [G.union_agg(b).alias(b) for b in boxes]
    out = runs.groupBy(*key, "entity", "field").agg(parts.alias("_parts"), *more)
    return out.withColumn("text", F.array_join(F.transform("_parts", lambda p: p["w"]), " ")).withColumn("token_indices", F.transform("_parts", lambda p: p["o"])).drop("_parts")


def first_subtokens(pieces: DataFrame, key: list[str], word: str, order: list[str]) -> DataFrame:
    """The first piece of each word: it keeps the word's label."""
    return ranked(pieces, "_r", [*key, word], order).where("_r = 0").drop("_r")


def dedup_tokens(tokens: DataFrame, key: str = "doc", word: str = "text", box: str = "bbox", confidence: str = "ocr_confidence", pos: str = "pos", threshold: float = DEDUP_IOU, unicode: bool = True) -> DataFrame:
    """Tokens without such that repeat, by normal form and overlap, one of greater confidence that stays.

    Only equal normal forms can be duplicates, so those that are alone on their page skip the grouped function.
    """
    norm = text.normalize(F.col(word), unicode=unicode)
    seen = tokens.withColumn("_norm", norm)
    small = seen.select(key, "_norm", F.col(pos).cast("long").alias("p"), F.col(confidence).cast("double").alias("c"), *[F.col(f"{box}.{n}").cast("double").alias(n) for n in G.XYXY])

    def run(group: Arrays) -> Arrays:
        at = np.lexsort((group["p"], -group["c"]))
        b = np.stack([group[n][at] for n in G.XYXY], axis=1)
        size = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            k = np.array(kept, dtype=int)
            both = np.maximum(0, np.minimum(b[k, 2], b[i, 2]) - np.maximum(b[k, 0], b[i, 0])) * np.maximum(0, np.minimum(b[k, 3], b[i, 3]) - np.maximum(b[k, 1], b[i, 1]))
            union = size[k] + size[i] - both
            if not (both[union > 0] / union[union > 0] >= threshold).any():
                kept.append(i)
        return {"p": group["p"][at[kept]]}

    counted = small.withColumn("n", F.count("*").over(Window.partitionBy(key, "_norm")))
    alone = counted.where("n = 1").select(key, "p")
    stay = map_groups(counted.where("n > 1").drop("n"), [key, "_norm"], ["p"], run, {"p": "int64"}, f"{key} {dict(tokens.dtypes)[key]}, _norm string, p long").select(key, "p")
    kept = alone.unionByName(stay).withColumn(pos, F.col("p").cast(dict(tokens.dtypes)[pos])).select(key, pos)
    return tokens.join(kept, [key, pos], "left_semi")


def split_boxes(tokens: DataFrame, word: str = "text", box: str = "bbox", normal: Column | None = None, unicode: bool = True) -> DataFrame:
    """One row to each word of a token's text: `piece_no`, `piece` and `piece_box`, the token's box shared out by the
    words' lengths, from the right if the text holds Arabic. A single word keeps the box, no word gives no row."""
    norm = text.normalize(F.col(word), strip_diacritics=False, unicode=unicode) if normal is None else normal
    b = F.col(box)
    seen = tokens.withColumn("_p", text.words(norm)).withColumn("_w", F.greatest(F.lit(1), b["x2"] - b["x1"]).cast("double")).withColumn("_t", F.aggregate("_p", F.lit(0), lambda t, p: t + F.length(p))).withColumn("_rtl", text.is_arabic(F.col(word)))
    rows = seen.select("*", F.posexplode("_p").alias("piece_no", "piece"))
    sofar = F.aggregate(F.slice("_p", 1, F.col("piece_no")), F.lit(0), lambda t, p: t + F.length(p))
    start, end = F.col("_w") * sofar / F.col("_t"), F.col("_w") * (sofar + F.length("piece")) / F.col("_t")
    many, far = F.size("_p") > 1, F.lit(G.UNBOUNDED)
    left = G.clipped(b["x1"] + start, b["y1"], b["x1"] + end, b["y2"], far, far)
    right = G.clipped(b["x2"] - end, b["y1"], b["x2"] - start, b["y2"], far, far)
    return rows.withColumn("piece_box", F.when(many & F.col("_rtl"), right).when(many, left).otherwise(b)).drop("_p", "_w", "_t", "_rtl")


def detection_ids(boxes: DataFrame, key: str, order: list) -> DataFrame:
    """det_0000, det_0001, .. within each document."""
    return ranked(boxes, "_n", [key], order).withColumn("detection_id", F.concat(F.lit("det_"), F.lpad(F.col("_n").cast("string"), 4, "0"))).drop("_n")


def padded_number(number: Column, total: int) -> Column:
    """A number with as many digits as the total has."""
    return F.lpad(number.cast("string"), len(str(total)), "0")
