"""Matching boxes: nearest regions, boxes within fields, greedy one-to-one assignment, average precision."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quireflow.constants import ALIGN_IOU, AP_THRESHOLDS, FIELD_IOU
from quireflow.functions import geometry as G
from quireflow.operators.grouped import Arrays, map_groups, map_tables

#: Ranges of confidence for running sums.
BANDS = 4096
#: Thresholds whose hits share a long, and steps of a precision envelope in a row.
LEVELS, STEPS = 62, 4096


def nearest_region(tokens: DataFrame, regions: DataFrame, key: str = "doc", token_pos: str = "pos", region_pos: str = "region_pos") -> DataFrame:
    """tokens(key, pos, bbox) with region_box: of the regions(key, region_pos, bbox) that overlap the token the one
    with the nearest centre, the first one of equals; the token's own box if none does."""
    r = regions.select(F.col(key).alias("_k"), F.col(region_pos).alias("_rp"), F.col("bbox").alias("_rb"))
    met = tokens.join(r, (tokens[key] == F.col("_k")) & G.overlaps(F.col("bbox"), F.col("_rb")), "left")
    near = Window.partitionBy(key, token_pos).orderBy(F.coalesce(G.center_distance(F.col("bbox"), F.col("_rb")), F.lit(0.0)), "_rp")
    best = met.withColumn("_r", F.row_number().over(near)).where("_r = 1")
    return best.withColumn("region_box", F.coalesce("_rb", "bbox")).drop("_k", "_rp", "_rb", "_r")


def tokens_in_fields(tokens: DataFrame, fields: DataFrame, key: str = "doc", threshold: float = FIELD_IOU) -> DataFrame:
    """Pairs of a field (key, label, bbox) and a token (key, .., bbox) whose centre lies in the field's box or that
    overlaps it enough."""
    f = fields.select(F.col(key).alias("_k"), "label", F.col("bbox").alias("field_box"))
    hit = G.center_inside(F.col("bbox"), F.col("field_box")) | (G.iou(F.col("bbox"), F.col("field_box")) > threshold)
    return tokens.join(f, (tokens[key] == F.col("_k")) & hit).drop("_k")


def iou_pairs(a: DataFrame, b: DataFrame, key: list[str], a_pos: str, b_pos: str) -> DataFrame:
    """(key.., a_pos, b_pos, iou) of boxes of one document that overlap at all: an equi-join with a residual."""
    left = a.select(*key, a_pos, F.col("bbox").alias("_a"))
    right = b.select(*key, b_pos, F.col("bbox").alias("_b"))
    return left.join(right, key).withColumn("iou", G.iou(F.col("_a"), F.col("_b"))).where("iou > 0").drop("_a", "_b")


def _greedy(first: np.ndarray, other: np.ndarray, iou: np.ndarray, threshold: float) -> dict[int, tuple[int, float]]:
    """Items of `first`, in ascending order, take their best item of `other` that is still free; of equals the first."""
    order = np.lexsort((other, -iou, first))
    taken: set[int] = set()
    out: dict[int, tuple[int, float]] = {}
    best: dict[int, float] = {}
    for i in order.tolist():
        f, o = int(first[i]), int(other[i])
        if f in best or o in taken:
            continue
        best[f] = float(iou[i])
        if iou[i] >= threshold:
            taken.add(o)
            out[f] = o, float(iou[i])
    return out


def greedy_align(truth: DataFrame, predicted: DataFrame, key: str = "doc", truth_pos: str = "pos", predicted_pos: str = "pred_pos", threshold: float = ALIGN_IOU) -> DataFrame:
    """(key, truth_pos, predicted_pos, iou): true boxes in their order take the free predicted box that overlaps them
    most, if it does so enough. Only overlapping pairs reach the grouped function, a document at a time."""

    def run(pairs: Arrays) -> Arrays:
        found = _greedy(pairs["t"], pairs["p"], pairs["iou"], threshold)
        first = np.array(list(found), dtype=np.int64)
        return {truth_pos: first, predicted_pos: np.array([o for o, _ in found.values()], dtype=np.int64), "iou": np.array([i for _, i in found.values()], dtype=float)}

    pairs = iou_pairs(truth, predicted, [key], truth_pos, predicted_pos)
    small = pairs.select(key, F.col(truth_pos).cast("long").alias("t"), F.col(predicted_pos).cast("long").alias("p"), "iou")
    out = {truth_pos: "int64", predicted_pos: "int64", "iou": "double"}
    return map_groups(small, [key], ["t", "p"], run, out, f"{key} {dict(pairs.dtypes)[key]}, {truth_pos} long, {predicted_pos} long, iou double")


def _matched(table: pa.Table, starts: np.ndarray, stops: np.ndarray, thresholds: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of whole groups: a row of each prediction, its hits and its overlaps by threshold. A pair without
    overlap stands for a prediction that overlaps nothing."""
    column = lambda n: table.column(n).to_numpy()
    group = np.repeat(np.arange(len(starts)), stops - starts)
    # candidates of each prediction side by side: predictions by confidence, their candidates by overlap
    at = np.lexsort((column("pos"), -column("iou"), column("pred_pos"), -column("confidence"), group))
    group, name, other, iou = group[at], column("pred_pos")[at], column("pos")[at], column("iou")[at]
    first = np.nonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (group[1:] != group[:-1]))))[0]
    best = np.repeat(iou[first][:, None], len(thresholds), axis=1)
    hits = (best >= np.array(thresholds)) & (best > 0)
    # only where predictions share a true box does it matter which of them comes first
    met = np.nonzero(iou > 0)[0]
    met = met[np.lexsort((other[met], group[met]))]
    shared = np.unique(group[met[1:]][(group[met[1:]] == group[met[:-1]]) & (other[met[1:]] == other[met[:-1]])])
    ends = np.append(first[1:], len(name))
    lows, highs = np.searchsorted(group[first], shared), np.searchsorted(group[first], shared, side="right")
    for low, high in zip(lows.tolist(), highs.tolist()):
        own = list(zip(range(low, high), first[low:high].tolist(), ends[low:high].tolist()))
        base = own[0][1]
        others, ious = other[base : own[-1][2]].tolist(), iou[base : own[-1][2]].tolist()
        for i, t in enumerate(thresholds):
            taken: set[int] = set()
            for k, s, e in own:
                found = next((x for x in range(s - base, e - base) if ious[x] > 0 and others[x] not in taken), None)
                overlap = ious[found] if found is not None else 0.0
                hits[k, i] = hit = found is not None and overlap >= t
                best[k, i] = overlap
                if hit:
                    taken.add(others[found])
    return at[first], hits, best


def matches(predicted: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], keys: list[str]) -> DataFrame:
    """(keys.., pred_pos, confidence, m0.., best, bests): a row to each prediction. Its hits are bits of m0, m1.., LEVELS
    thresholds to each; best is its overlap, unless it differs by threshold: bests has them then, else it is null.

    Predictions take true boxes by descending confidence, within a group of `keys`; where a key is null, they take none.
    They are set apart, so that both sides are read alike: boxes of one table then share a shuffle."""
    known = predicted.where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    words = range(0, len(thresholds), LEVELS)

    def run(table: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
        rows, hits, best = _matched(table, starts, stops, thresholds)
        own = [table.column(n).combine_chunks().take(pa.array(rows)) for n in [*keys, "pred_pos", "confidence"]]
        for w in words:
            part = hits[:, w : w + LEVELS].astype(np.int64)
            own.append(pa.array((part << np.arange(part.shape[1])).sum(axis=1)))
        differ = (best != best[:, :1]).any(axis=1)
        offsets = np.concatenate(([0], np.cumsum(differ * len(thresholds)))).astype(np.int32)
        bests = pa.ListArray.from_arrays(pa.array(offsets), pa.array(best[differ].ravel()), mask=pa.array(~differ))
        return pa.RecordBatch.from_arrays([*own, pa.array(best[:, 0]), bests], names)

    names = [*keys, "pred_pos", "confidence", *(f"m{i}" for i in range(len(words))), "best", "bests"]
    left = known.select(*keys, F.col("pred_pos").cast("long").alias("pred_pos"), F.col("confidence").cast("double").alias("confidence"), F.col("bbox").alias("_a"))
    right = truth.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").cast("long").alias("pos"), F.col("bbox").alias("_b"))
    on = G.iou(F.col("_a"), F.col("_b")) > 0
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    iou = F.coalesce(G.iou(F.col("_a"), F.col("_b")), F.lit(0.0))
    pairs = left.join(right, on, "left").select(*keys, "pred_pos", "confidence", F.coalesce("pos", F.lit(-1)).alias("pos"), iou.alias("iou"))
    kinds = dict(predicted.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pred_pos long, confidence double", *(f"m{i} long" for i in range(len(words))), "best double, bests array<double>"])
    nothing = [*(F.lit(0).cast("long").alias(f"m{i}") for i in range(len(words))), F.lit(0.0).alias("best"), F.lit(None).cast("array<double>").alias("bests")]
    unknown = predicted.where(reduce(or_, (F.col(k).isNull() for k in keys))).select(*keys, F.col("pred_pos").cast("long").alias("pred_pos"), F.col("confidence").cast("double").alias("confidence"), *nothing)
    return map_tables(pairs, keys, ["pred_pos", "pos"], run, schema).unionByName(unknown)


def detections_matched(predicted: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = AP_THRESHOLDS, key: str = "doc", by: tuple[str, ...] = ()) -> DataFrame:
    """predicted(key, pred_pos, bbox, confidence) with threshold, tp and best_iou, a row to each threshold.

    Predictions take true boxes by descending confidence, within a document (and the columns `by`, such as a class).
    Overlaps are computed once for all thresholds, which repeat rows only at the end.
    """
    keys = [key, *by]
    found = matches(predicted, truth, thresholds, keys).drop("confidence")
    base = predicted.withColumn("pred_pos", F.col("pred_pos").cast("long"))
    level = lambda i, t: F.struct(F.lit(t).alias("threshold"), F.coalesce(F.shiftright(f"m{i // LEVELS}", i % LEVELS).bitwiseAND(F.lit(1)), F.lit(0)).cast("int").alias("tp"), F.coalesce(F.get("bests", F.lit(i)), "best", F.lit(0.0)).alias("best_iou"))
    levels = F.explode(F.array(*(level(i, t) for i, t in enumerate(thresholds))))
    return base.join(found, [*keys, "pred_pos"], "left").withColumn("_level", levels).select(*base.columns, "_level.*")


def _band() -> Column:
    """Ranges of descending confidence."""
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    return (F.lit(BANDS - 1) - F.floor(level * (BANDS - 1))).cast("int")


def average_precision(flags: DataFrame, totals: DataFrame, by: list[str], order: list) -> DataFrame:
    """(by.., ap, precision, recall, n): area under the precision envelope, from flags(by.., confidence, tp) and
    totals(by.., total), the number of true boxes. `order` begins with descending confidence.

    Precision at a point is the greatest one at or after it; the area sums it over the steps in recall. Running sums
    over all predictions would be one task's sort, so confidences are cut into BANDS ranges: sums of whole bands come
    from one row to a band, and windows run within bands.
    """
    seen = flags.withColumn("_band", _band())
    keys, whole = [*by, "_band"], Window.partitionBy(*by)
    sums = seen.groupBy(*keys).agg(F.sum("tp").alias("_t"), F.count("*").alias("_c"))
    ahead = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    points = seen.join(starts, keys).withColumn("_n", F.row_number().over(inside)).withColumn("_p", (F.col("_t0") + F.sum("tp").over(sofar)) / (F.col("_n0") + F.col("_n")))
    later = whole.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tops = points.groupBy(*keys).agg(F.max("_p").alias("_top")).select(*keys, F.max("_top").over(later).alias("_later"))
    envelope = F.greatest(F.max("_p").over(after), F.coalesce("_later", F.lit(0.0)))
    steps = points.join(tops, keys).withColumn("_env", envelope).groupBy(*by).agg(F.sum(F.col("tp") * F.col("_env")).alias("_area"), F.sum("tp").alias("_hits"), F.count("*").alias("n"))
    out = steps.join(totals, by)
    ok = F.col("total") > 0
    return out.select(*by, F.when(ok, F.col("_area") / F.col("total")).otherwise(0.0).alias("ap"), F.when(ok, F.col("_hits") / F.col("n")).otherwise(0.0).alias("precision"), F.when(ok, F.col("_hits") / F.col("total")).otherwise(0.0).alias("recall"), "n")


def _bits(batch: pa.RecordBatch, count: int) -> Iterator[np.ndarray]:
    """By threshold, whether each row is a hit."""
    words = [batch.column(f"m{w}").to_numpy() for w in range((count + LEVELS - 1) // LEVELS)]
    return ((words[i // LEVELS] >> (i % LEVELS) & 1).astype(bool) for i in range(count))


def _envelope(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values raised to the greatest at or after each; equal ones side by side are one, their counts added."""
    values = np.maximum.accumulate(values[::-1])[::-1]
    first = np.nonzero(np.concatenate(([True], values[1:] != values[:-1])))[0]
    return values[first], np.add.reduceat(counts, first)


def detection_metrics(predicted: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = AP_THRESHOLDS, key: str = "doc") -> DataFrame:
    """(threshold, ap, precision, recall, mean_iou, n): one row to each threshold, none without predictions.

    As average_precision() has it, for all thresholds at once: a prediction is one row whose hits are bits, and is dealt
    out once, by its band of confidence. A first pass over the bands sums them up, a second one goes through each in
    order and gives the steps of its envelope, of which there are few."""
    count = len(thresholds)
    dealt = matches(predicted, truth, thresholds, [key]).withColumn("_band", _band()).repartition("_band")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, hits, seen, values, counts = None, [], 0, [], []

        def over() -> Iterator[pa.RecordBatch]:
            for i in range(count if band is not None else 0):
                for part, at in enumerate(range(0, len(values[i]), STEPS)):
                    columns = [pa.array([x], pa.int32()) for x in (i, band, part)]
                    columns += [pa.array([x[i][at : at + STEPS]], kind) for x, kind in ((values, pa.list_(pa.float64())), (counts, pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, ["_i", "_band", "_part", "_values", "_counts"])

        for batch in batches:
            heads = batch.column("_head")
            cuts = np.nonzero(~heads.is_null().to_numpy(zero_copy_only=False))[0].tolist()
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(s, e - s)
                if e > s and (head := heads[s].as_py()) is not None:
                    yield from over()
                    head = json.loads(head)
                    band, seen, hits = head["_band"], head["_n0"], head["_t0"]
                    values, counts = [np.zeros(0)] * count, [np.zeros(0, dtype=np.int64)] * count
                for i, hit in enumerate(_bits(part, count)):
                    at = np.nonzero(hit)[0]
                    if len(at):
                        precision = (hits[i] + np.arange(1, len(at) + 1)) / (seen + at + 1)
                        values[i], counts[i] = _envelope(np.concatenate((values[i], precision)), np.concatenate((counts[i], np.ones(len(at), dtype=np.int64))))
                        hits[i] += len(at)
                seen += e - s
        yield from over()

    # every column is named, so that both passes read one shuffle
    hit = lambda i: F.shiftright(f"m{i // LEVELS}", i % LEVELS).bitwiseAND(F.lit(1))
    overlap = lambda i: F.coalesce(F.get("bests", F.lit(i)), F.col("best"))
    sums = dealt.groupBy("_band").agg(F.count("*").alias("_c"), F.max(F.xxhash64(key, "pred_pos", "confidence")).alias("_any"), *(f(c(i)).alias(f"{n}{i}") for i in range(count) for n, f, c in (("t", F.sum, hit), ("o", F.sum, overlap)))).where("_any is not null")
    levels = F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"t{i}").alias("_t"), F.col(f"o{i}").alias("_iou")) for i in range(count)))
    bands = sums.select("_band", "_c", F.explode(levels).alias("_s")).select("_band", "_c", "_s.*")
    ahead = Window.partitionBy("_i").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    before = bands.select("_i", "_band", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in ("_t", "_c")))
    starts = before.groupBy("_band").agg(F.sort_array(F.collect_list(F.struct("_i", "_t0"))).alias("_all"), F.max("_c0").alias("_n0")).select("_band", F.col("_all._t0").alias("_t0"), "_n0")
    place = F.row_number().over(Window.partitionBy("_band").orderBy(F.col("confidence").desc(), key, "pred_pos"))
    words = [c for c in dealt.columns if c in {f"m{w}" for w in range(count)}]
    # at most BANDS rows are broadcast; the join leaves the order as it is, and the first row of a band brings its sums.
    # Columns are few: each costs time a row on its way to Python
    head = F.when(F.col("_place") == 1, F.to_json(F.struct("_band", "_t0", "_n0", "best", "bests")))
    rows = dealt.withColumn("_place", place).join(F.broadcast(starts), "_band", "left").select(head.alias("_head"), *words)
    found = rows.mapInArrow(steps, "_i int, _band int, _part int, _values array<double>, _counts array<long>")
    after = Window.partitionBy("_i").orderBy(F.col("_band").desc(), F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = found.withColumn("_later", F.coalesce(F.max(F.get("_values", F.lit(0))).over(after), F.lit(0.0)))
    area = F.aggregate(F.zip_with("_values", "_counts", lambda v, c: F.greatest(v, F.col("_later")) * c), F.lit(0.0), lambda a, x: a + x)
    areas = later.groupBy("_i").agg(F.sum(area).alias("_area"))
    whole = bands.groupBy("_i").agg(F.sum("_t").alias("_hits"), F.sum("_c").alias("n"), F.sum("_iou").alias("_iou"))
    out = whole.join(areas, "_i", "left").crossJoin(F.broadcast(truth.agg(F.count("*").alias("total"))))
    share = lambda a, b: F.when(F.col("total") > 0, F.coalesce(F.col(a), F.lit(0.0)) / F.col(b)).otherwise(0.0)
    return out.select(F.get(F.array(*map(F.lit, thresholds)), F.col("_i")).alias("threshold"), share("_area", "total").alias("ap"), share("_hits", "n").alias("precision"), share("_hits", "total").alias("recall"), (F.col("_iou") / F.col("n")).alias("mean_iou"), "n")


def mean_average_precision(metrics: DataFrame) -> DataFrame:
    """(map_50, map_50_95) of detection_metrics()."""
    return metrics.agg(F.coalesce(F.max(F.when(F.abs(F.col("threshold") - 0.5) < 1e-9, F.col("ap"))), F.lit(0.0)).alias("map_50"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map_50_95"))


def class_average_precision(matched: DataFrame, truth_counts: DataFrame) -> DataFrame:
    """(label, ap, n): per class from matched(label, confidence, tp); truth_counts(label, total). A class without
    true boxes counts as having one; of equal confidences hits come first; classes without predictions are left out."""
    totals = matched.select("label").distinct().join(truth_counts, "label", "left").select("label", F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)).alias("total"))
    return average_precision(matched, totals, ["label"], [F.col("confidence").desc(), F.col("tp").desc()]).select("label", "ap", "n")


def best_by_label(truth: DataFrame, predicted: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """(key, label, pos, iou): each true box's best overlap with a predicted box of its label, which may serve several;
    true boxes without a predicted one of their label are left out."""
    p = predicted.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("bbox").alias("_b"))
    met = truth.join(p, (truth[key] == F.col("_k")) & (truth["label"] == F.col("_l")))
    return met.groupBy(key, "label", pos).agg(F.max(G.iou(F.col("bbox"), F.col("_b"))).alias("iou"))


def zipped(a: DataFrame, b: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Items of equal place in both, up to the shorter one."""
    return a.join(b, [*key, pos])
