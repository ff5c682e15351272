"""Queries over orders and parts: totals, prices, names, boxes made of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow.functions import geometry as G, text
from quireflow.operators import augment, crops, generate, matching, metrics, ordering, pairing
from quireflow.plans.registry import query, table

#: Boxes of line items: a page of 2000 by 2000 pixels for each order.
SIDE = 2000
_BOXES = """
boxes AS (
    SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) - 1 AS pos,
           (l_quantity * 30)::INT AS x1, floor(l_extendedprice / 60)::INT AS y1, (l_quantity * 30)::INT + 60 + (l_partkey % 200)::INT AS x2, floor(l_extendedprice / 60)::INT + 20 + (l_suppkey % 40)::INT AS y2,
           l_discount AS d, l_linenumber AS n, l_returnflag AS label
    FROM lineitem
)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, bbox, d, n, label): a box to each line item. The window comes before the columns made of its rows: so only
    the table's own columns are shuffled, once for all boxes of a query, and later joins by document find them dealt."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag"]
    li = table(spark, sf_dir, "lineitem").withColumn("_place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    pos = (F.col("_place") - 1).cast("long")
    x1, y1 = (F.col("l_quantity") * 30).cast("int"), F.floor(F.col("l_extendedprice") / 60).cast("int")
    b = G.box(x1, y1, x1 + 60 + (F.col("l_partkey") % 200).cast("int"), y1 + 20 + (F.col("l_suppkey") % 40).cast("int"))
    return li.select(F.col("l_orderkey").alias("doc"), pos.alias("pos"), b.alias("bbox"), F.col("l_discount").alias("d"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("label"))


def flat(b: str = "bbox") -> list[Column]:
    return [F.col(f"{b}.{n}").alias(n) for n in G.XYXY]


@query(
    """
SELECT l_orderkey, subtotal, round(subtotal * 0.15, 2)::DECIMAL(28,2) AS tax, (subtotal + round(subtotal * 0.15, 2))::DECIMAL(28,2) AS total
FROM (SELECT l_orderkey, sum(p_retailprice::DECIMAL(18,2) * l_quantity::DECIMAL(10,0))::DECIMAL(28,2) AS subtotal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
"""
)
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return generate.invoice_totals(items, "l_orderkey", F.col("p_retailprice"), F.col("l_quantity"))


@query(
    """
WITH sums AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS stated, lines, CASE WHEN lines IS NULL THEN 'no lines' WHEN abs(o_totalprice::DECIMAL(18,2) - lines) <= 0.01 THEN 'equal' ELSE 'differs' END AS state
FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey
"""
)
def totals_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("lines"))
    stated = F.col("o_totalprice").cast("decimal(18,2)")
    state = F.when(F.col("lines").isNull(), "no lines").when(F.abs(stated - F.col("lines")) <= 0.01, "equal").otherwise("differs")
    return table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", stated.alias("stated"), "lines", state.alias("state"))


_CATEGORY = "CASE p_size % 6 WHEN 0 THEN 'Water' WHEN 1 THEN 'Vegetables & Fruits' WHEN 2 THEN 'Cleaning Supplies' WHEN 3 THEN 'Tins and Jars' WHEN 4 THEN 'Rice' ELSE p_type END"


@query(
    f"""
SELECT category, CASE category WHEN 'Water' THEN 5 WHEN 'Vegetables & Fruits' THEN 10 WHEN 'Cleaning Supplies' THEN 30 WHEN 'Tins and Jars' THEN 15 WHEN 'Rice' THEN 15 ELSE 5 END AS low,
       CASE category WHEN 'Water' THEN 30 WHEN 'Vegetables & Fruits' THEN 50 WHEN 'Cleaning Supplies' THEN 200 WHEN 'Tins and Jars' THEN 80 WHEN 'Rice' THEN 80 ELSE 500 END AS high, n
FROM (SELECT {_CATEGORY} AS category, count(*) AS n FROM part GROUP BY 1)
"""
)
def price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = generate.price_band(F.col("category"))
    parts = table(spark, sf_dir, "part").select(F.expr(_CATEGORY).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return parts.select("category", band["low"].alias("low"), band["high"].alias("high"), "n")


@query("SELECT p_partkey, p_name AS description FROM part")
def brand_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that aren't Arabic never go before a name."""
    return table(spark, sf_dir, "part").select("p_partkey", text.with_brand(F.col("p_name"), F.col("p_brand")).alias("description"))


@query(
    f"""
WITH {_BOXES}, clip AS (SELECT *, least(x1, {SIDE - 1}) AS a, least(y1, {SIDE - 1}) AS b, least(x2, {SIDE - 1}) AS c, least(y2, {SIDE - 1}) AS e FROM boxes)
SELECT doc, pos, round_even(a * 1000.0 / {SIDE}, 0)::INT AS x1, round_even(b * 1000.0 / {SIDE}, 0)::INT AS y1, round_even(c * 1000.0 / {SIDE}, 0)::INT AS x2, round_even(e * 1000.0 / {SIDE}, 0)::INT AS y2 FROM clip
"""
)
def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.lit(SIDE)
    clip = boxes(spark, sf_dir).withColumn("bbox", G.clipped(F.col("bbox.x1"), F.col("bbox.y1"), F.col("bbox.x2"), F.col("bbox.y2"), side, side))
    return clip.withColumn("bbox", G.normalized(F.col("bbox"), side, side)).select("doc", "pos", *flat())


_IOU = """CASE WHEN ({a}x2 - {a}x1)::DOUBLE * ({a}y2 - {a}y1) + ({b}x2 - {b}x1)::DOUBLE * ({b}y2 - {b}y1) - greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))::DOUBLE * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) > 0
THEN greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))::DOUBLE * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) /
    (({a}x2 - {a}x1)::DOUBLE * ({a}y2 - {a}y1) + ({b}x2 - {b}x1)::DOUBLE * ({b}y2 - {b}y1) - greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))::DOUBLE * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))) ELSE 0 END"""


@query(f"WITH {_BOXES} SELECT a.doc, a.pos, b.pos AS pos_b, round({_IOU.format(a='a.', b='b.')}, 9) AS iou FROM boxes a JOIN boxes b ON a.doc = b.doc AND b.pos = a.pos + 1")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of neighbouring line items' boxes."""
    a = boxes(spark, sf_dir).withColumn("_b", F.lead("bbox").over(Window.partitionBy("doc").orderBy("pos"))).where("_b is not null")
    return a.select("doc", "pos", (F.col("pos") + 1).alias("pos_b"), F.round(G.iou(F.col("bbox"), F.col("_b")), 9).alias("iou"))


@query(f"WITH {_BOXES} SELECT doc, label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes GROUP BY doc, label")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("doc", "label").agg(G.union_agg("bbox").alias("b"), F.count("*").alias("n")).select("doc", "label", *flat("b"), "n")


@query(
    f"""
WITH {_BOXES}, c AS (SELECT doc, pos, x1 / {SIDE}.0 AS a, y1 / {SIDE}.0 AS b, x2 / {SIDE}.0 AS c, y2 / {SIDE}.0 AS d FROM boxes)
SELECT doc, pos, round(a, 9) AS ax, round(b, 9) AS ay, round(c, 9) AS bx, round(b, 9) AS "by", round(c, 9) AS cx, round(d, 9) AS cy, round(a, 9) AS dx, round(d, 9) AS dy FROM c
"""
)
def obb_from_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    ann = F.struct(b["x1"].cast("double").alias("x"), b["y1"].cast("double").alias("y"), (b["x2"] - b["x1"]).cast("double").alias("width"), (b["y2"] - b["y1"]).cast("double").alias("height"))
    obb = boxes(spark, sf_dir).withColumn("o", G.obb_from_bbox(ann, F.lit(SIDE), F.lit(SIDE)))
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    return obb.select("doc", "pos", *[F.round(F.col("o")[i], 9).alias(n) for i, n in enumerate(names)])


@query(
    f"""
WITH {_BOXES}, m AS (SELECT radians(7.0) AS t), w AS (
    SELECT t, cos(t) AS co, sin(t) AS si, trunc({SIDE} * abs(sin(t)) + {SIDE} * abs(cos(t)))::INT AS side FROM m
), k AS (SELECT *, (1 - co) * {SIDE // 2} - si * {SIDE // 2} + side / 2.0 - {SIDE // 2} AS tx, si * {SIDE // 2} + (1 - co) * {SIDE // 2} + side / 2.0 - {SIDE // 2} AS ty FROM w)
SELECT doc, pos, trunc(greatest(0, least(side - 1, co * x1 + si * y1 + tx)))::INT AS ax, trunc(greatest(0, least(side - 1, -si * x1 + co * y1 + ty)))::INT AS ay,
       trunc(greatest(0, least(side - 1, co * x2 + si * y2 + tx)))::INT AS cx, trunc(greatest(0, least(side - 1, -si * x2 + co * y2 + ty)))::INT AS cy
FROM boxes, k
"""
)
def affine_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by 7 degrees: two opposite corners on the new canvas."""
    b = F.col("bbox")
    ann = F.struct(b["x1"].cast("double").alias("x"), b["y1"].cast("double").alias("y"), (b["x2"] - b["x1"]).cast("double").alias("width"), (b["y2"] - b["y1"]).cast("double").alias("height"))
    p = G.rotated_polygon(ann, G.rotation(F.lit(7.0), F.lit(SIDE), F.lit(SIDE)))
    return boxes(spark, sf_dir).withColumn("p", p).select("doc", "pos", F.col("p")[0]["x"].alias("ax"), F.col("p")[0]["y"].alias("ay"), F.col("p")[2]["x"].alias("cx"), F.col("p")[2]["y"].alias("cy"))


@query(f"WITH {_BOXES} SELECT doc, pos, greatest(0, x1 - 25)::INT AS x1, greatest(0, y1 - 25)::INT AS y1, least({SIDE}, x2 + 25)::INT AS x2, least({SIDE}, y2 + 25)::INT AS y2 FROM boxes WHERE least({SIDE}, x2 + 25) > greatest(0, x1 - 25) AND least({SIDE}, y2 + 25) > greatest(0, y1 - 25)")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of line items' boxes, padded and cut at the page; crops without area are left out."""
    b = F.col("bbox")
    ann = F.struct(b["x1"].cast("double").alias("x"), b["y1"].cast("double").alias("y"), (b["x2"] - b["x1"]).cast("double").alias("width"), (b["y2"] - b["y1"]).cast("double").alias("height"))
    tokens = boxes(spark, sf_dir).select(F.col("doc").cast("string").alias("stem"), "doc", "pos", ann.alias("bbox"), F.lit(None).cast("struct<vertices:array<struct<x:double,y:double>>>").alias("bounding_poly"), F.lit("word").alias("text"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    out = tokens.withColumn("box", G.padded_bbox(F.col("bbox"), 25, F.col("width"), F.col("height"))).where("box.x2 > box.x1 and box.y2 > box.y1")
    return out.select("doc", "pos", *flat("box"))


@query(
    f"""
WITH {_BOXES}, c AS (SELECT *, greatest(0, x1 - 5) AS cx, greatest(0, y1 - 5) AS cy FROM boxes), s AS (SELECT doc, pos, cx, cy, least({SIDE} - cx, x2 - x1 + 10) AS w, least({SIDE} - cy, y2 - y1 + 10) AS h FROM c)
SELECT doc, pos, doc::VARCHAR || '_' || pos::VARCHAR || '.png' AS crop, cx::INT AS x, cy::INT AS y, w::INT AS width, h::INT AS height FROM s WHERE w >= 10 AND h >= 34
"""
)
def crop_boxes_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    ann = F.struct(b["x1"].cast("double").alias("x"), b["y1"].cast("double").alias("y"), (b["x2"] - b["x1"]).cast("double").alias("width"), (b["y2"] - b["y1"]).cast("double").alias("height"))
    tokens = boxes(spark, sf_dir).select(F.col("doc").cast("string").alias("stem"), "pos", ann.alias("bbox"), F.lit("word").alias("text"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    out = crops.crop_set_corrected(tokens, 5, 10, 34)
    return out.select(F.col("stem").cast("long").alias("doc"), F.col("crop_index").alias("pos"), "crop", "box.x", "box.y", "box.width", "box.height")


@query(f"WITH {_BOXES} SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY floor(y1 / 50), x1 DESC, pos)::INT - 1 AS reading_order FROM boxes")
def reading_order_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.bucket_order(boxes(spark, sf_dir), "doc", F.col("bbox.y1"), F.col("bbox.x1"), "pos").select("doc", "pos", "reading_order")


@query(f"WITH {_BOXES} SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY y1, x1 DESC, pos)::INT - 1 AS reading_order FROM boxes")
def reading_order_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.strict_order(boxes(spark, sf_dir), "doc", F.col("bbox.y1"), F.col("bbox.x1"), "pos").select("doc", "pos", "reading_order")


@query(f"WITH {_BOXES} SELECT doc, greatest(8, trunc(median(greatest(1, y2 - y1)) * 0.6)::INT) AS tolerance FROM boxes GROUP BY doc")
def line_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.line_tolerance(boxes(spark, sf_dir), "doc")


@query()
def reading_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line clustering around running means is sequential: the tests hold it against a plain loop."""
    return ordering.line_order(boxes(spark, sf_dir), "doc").select("doc", "pos", "reading_order")


_REGION = "SELECT doc, pos, x1 - 40 AS x1, y1 - 40 AS y1, x2 + 10 AS x2, y2 + 10 AS y2 FROM boxes WHERE n % 2 = 0"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bbox")
    return boxes(spark, sf_dir).where("n % 2 = 0").select("doc", F.col("pos").alias("region_pos"), G.box(b["x1"] - 40, b["y1"] - 40, b["x2"] + 10, b["y2"] + 10).alias("bbox"))


@query(
    f"""
WITH {_BOXES}, regions AS ({_REGION}), met AS (
    SELECT t.doc, t.pos, t.x1 AS tx1, t.y1 AS ty1, t.x2 AS tx2, t.y2 AS ty2, r.*, sqrt(pow((t.x1 + t.x2) / 2.0 - (r.x1 + r.x2) / 2.0, 2) + pow((t.y1 + t.y2) / 2.0 - (r.y1 + r.y2) / 2.0, 2)) AS dist
    FROM boxes t LEFT JOIN regions r ON t.doc = r.doc AND t.x1 < r.x2 AND t.x2 > r.x1 AND t.y1 < r.y2 AND t.y2 > r.y1
), best AS (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY coalesce(dist, 0), pos_1) AS k FROM met)
SELECT doc, pos, coalesce(x1, tx1) AS x1, coalesce(y1, ty1) AS y1, coalesce(x2, tx2) AS x2, coalesce(y2, ty2) AS y2 FROM best WHERE k = 1
""".replace("r.*,", "r.pos AS pos_1, r.x1, r.y1, r.x2, r.y2,")
)
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_region(boxes(spark, sf_dir), regions(spark, sf_dir)).select("doc", "pos", *flat("region_box"))


@query(
    f"""
WITH {_BOXES}, regions AS ({_REGION})
SELECT t.doc, t.pos, r.pos AS region_pos FROM boxes t JOIN regions r ON t.doc = r.doc
WHERE ((t.x1 + t.x2) / 2.0 BETWEEN r.x1 AND r.x2 AND (t.y1 + t.y2) / 2.0 BETWEEN r.y1 AND r.y2) OR {_IOU.format(a='t.', b='r.')} > 0.15
"""
)
def center_or_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = regions(spark, sf_dir).withColumnRenamed("region_pos", "label")
    return matching.tokens_in_fields(boxes(spark, sf_dir).drop("label"), fields).select("doc", "pos", F.col("label").alias("region_pos"))


@query(
    f"""
WITH {_BOXES}, p AS (SELECT doc, pos, label, x1 + 15 AS x1, y1 + 5 AS y1, x2 + 15 AS x2, y2 + 5 AS y2 FROM boxes WHERE n % 3 <> 0)
SELECT a.doc, a.label, a.pos, round(max({_IOU.format(a='a.', b='p.')}), 9) AS iou FROM boxes a JOIN p ON a.doc = p.doc AND a.label = p.label GROUP BY a.doc, a.label, a.pos
"""
)
def best_iou_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_by_label(boxes(spark, sf_dir), shifted(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes: two thirds of the true ones, a little off, with a confidence."""
    b = F.col("bbox")
    moved = G.box(b["x1"] + 15, b["y1"] + 5, b["x2"] + 15, b["y2"] + 5)
    return boxes(spark, sf_dir).where("n % 3 <> 0").select("doc", F.col("pos").alias("pred_pos"), moved.alias("bbox"), "label", (F.lit(0.5) + F.col("d")).alias("confidence"))


@query(
    f"""
WITH {_BOXES}, p AS (SELECT doc, pos, label, x1 + 15 AS x1, y1 + 5 AS y1, x2 + 15 AS x2, y2 + 5 AS y2 FROM boxes WHERE n % 3 <> 0),
best AS (SELECT a.label, max({_IOU.format(a='a.', b='p.')}) AS iou FROM boxes a JOIN p ON a.doc = p.doc AND a.label = p.label GROUP BY a.doc, a.label, a.pos)
SELECT label, round(avg(iou), 9) AS mean_iou, round(avg((iou >= 0.5)::INT), 9) AS recall_50, count(*) AS n FROM best GROUP BY ROLLUP (label)
"""
)
def iou_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.best_by_label(boxes(spark, sf_dir), shifted(spark, sf_dir))
    return metrics.iou_by_label(best).withColumn("mean_iou", F.round("mean_iou", 9)).withColumn("recall_50", F.round("recall_50", 9))


@query()
def greedy_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy assignment is sequential: the tests hold it against a plain loop."""
    return matching.greedy_align(boxes(spark, sf_dir), shifted(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


@query()
def detection_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision over greedy matches, by overlap threshold; see class_ap for the SQL of its sums."""
    rounded = matching.detection_metrics(shifted(spark, sf_dir).drop("label"), boxes(spark, sf_dir).drop("label"))
    return rounded.select(F.round("threshold", 2).alias("threshold"), *[F.round(c, 9).alias(c) for c in ("ap", "precision", "recall", "mean_iou")], "n")


@query(
    """
WITH f AS (SELECT l_returnflag AS label, l_discount AS confidence, (l_quantity > 20)::INT AS tp, l_orderkey, l_linenumber FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, tp DESC) AS k, sum(tp) OVER (PARTITION BY label ORDER BY confidence DESC, tp DESC ROWS UNBOUNDED PRECEDING) AS hits FROM f),
e AS (SELECT *, max(hits * 1.0 / k) OVER (PARTITION BY label ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env FROM o),
t AS (SELECT l_returnflag AS label, count(*) AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT e.label, round(sum(tp * env) / max(t.total), 9) AS ap, count(*) AS n FROM e JOIN t ON e.label = t.label GROUP BY e.label
"""
)
def class_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision by class from given hits: of equal confidences hits come first."""
    li = table(spark, sf_dir, "lineitem")
    flags = li.select(F.col("l_returnflag").alias("label"), F.col("l_discount").alias("confidence"), (F.col("l_quantity") > 20).cast("int").alias("tp"))
    totals = li.where("l_quantity > 10").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("total"))
    return matching.class_average_precision(flags, totals).withColumn("ap", F.round("ap", 9))


@query()
def dedup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal of repeated tokens is sequential: the tests hold it against a plain loop."""
    tokens = boxes(spark, sf_dir).select("doc", "pos", "bbox", F.col("label").alias("text"), F.col("d").alias("ocr_confidence"))
    wide = F.col("bbox")
    near = tokens.withColumn("bbox", G.box((wide["x1"] / 300).cast("int") * 300, (wide["y1"] / 300).cast("int") * 300, (wide["x1"] / 300).cast("int") * 300 + 280, (wide["y1"] / 300).cast("int") * 300 + 280 + F.col("pos").cast("int") % 3))
    return ordering.dedup_tokens(near, unicode=False).select("doc", "pos", "text")


@query(
    """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS piece, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS piece_no, p_size FROM part),
c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY p_partkey) AS total, coalesce(sum(length(piece)) OVER (PARTITION BY p_partkey ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY p_partkey) AS n FROM w)
SELECT p_partkey, piece_no::INT AS piece_no, piece, CASE WHEN n = 1 THEN 10 ELSE round_even(10 + 700.0 * before / total, 0)::INT END AS x1, CASE WHEN n = 1 THEN 710 ELSE round_even(10 + 700.0 * (before + length(piece)) / total, 0)::INT END AS x2 FROM c
"""
)
def token_box_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names' words share a box of 700 pixels by length."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), G.box(F.lit(10), F.lit(5), F.lit(710), F.lit(25)).alias("bbox"))
    return ordering.split_boxes(parts, unicode=False).select("p_partkey", "piece_no", "piece", "piece_box.x1", "piece_box.x2")


@query("SELECT bin, count(*) AS n FROM (SELECT least(floor((l_discount - lo) / (hi - lo) * 20) + 1, 20)::INT AS bin FROM lineitem, (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem)) GROUP BY ALL")
def discount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 20)


@query(
    """
WITH u AS (SELECT p_partkey, k, ('0x' || substr(md5('42:' || p_partkey || ':' || k), 1, 7))::BIGINT % 10000 / 10000.0 AS v FROM part, (VALUES ('thermal_print'), ('texture'), ('fold'), ('coffee_stain'), ('wrinkles'), ('ink_bleed'), ('blur'), ('jpeg_artifacts'), ('noise'), ('distortion'), ('color_jitter'), ('shadow'), ('perspective'), ('rotation')) t(k)),
c AS (SELECT * FROM (VALUES (1, 'thermal_print', 0.85), (2, 'texture', 0.9), (3, 'fold', 0.3), (4, 'coffee_stain', 0.15), (5, 'wrinkles', 0.4), (6, 'ink_bleed', 0.3), (7, 'blur', 0.85), (8, 'jpeg_artifacts', 0.9), (9, 'noise', 0.8), (10, 'distortion', 0.2), (11, 'color_jitter', 0.9), (12, 'shadow', 0.8)) t(i, k, chance)),
g AS (SELECT p_partkey, max(v) FILTER (WHERE k = 'perspective') AS p, max(v) FILTER (WHERE k = 'rotation') AS r FROM u GROUP BY 1)
SELECT g.p_partkey, CASE WHEN p < 0.3 THEN 'perspective' WHEN r < 0.6 THEN 'rotation' ELSE 'none' END AS geometry,
       coalesce((SELECT string_agg(u.k, ',' ORDER BY c.i) FROM u JOIN c ON u.k = c.k WHERE u.p_partkey = g.p_partkey AND u.v < c.chance), '') AS effects, 'augmented_' || g.p_partkey || '.jpg' AS output_name
FROM g
"""
)
def augment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = augment.augment_plan(table(spark, sf_dir, "part"), "p_partkey")
    return plan.select("p_partkey", "geometry", F.array_join("effects", ",").alias("effects"), "output_name")


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, 6, '0') AS number, 'det_' || lpad((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::VARCHAR, 4, '0') AS detection_id FROM part")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ordering.detection_ids(table(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")])
    return parts.select("p_partkey", ordering.padded_number(F.col("p_partkey"), 100_000).alias("number"), "detection_id")


@query(
    """
WITH r AS (SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'TAX' WHEN 2 THEN 'EMAIL' WHEN 3 THEN 'BRANCH' ELSE 'UNSEEN' END AS field FROM nation),
m AS (SELECT * FROM (VALUES ('grand_total', 'TOTAL'), ('total', 'TOTAL'), ('total_amount', 'TOTAL'), ('vat_amount', 'TAX'), ('vat_rate', 'TAX'), ('tax', 'TAX'), ('vat_taxable_qty', 'TAX'), ('email', 'EMAIL'), ('branch_name', 'BRANCH'), ('warehouse', 'BRANCH')) t(f, l))
SELECT n_nationkey, field, coalesce(f, lower(field)) AS gt_field FROM r LEFT JOIN m ON field = l
"""
)
def field_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.expr("CASE n_regionkey WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'TAX' WHEN 2 THEN 'EMAIL' WHEN 3 THEN 'BRANCH' ELSE 'UNSEEN' END")
    return pairing.to_annotation_fields(table(spark, sf_dir, "nation").select("n_nationkey", field.alias("field"))).select("n_nationkey", "field", "gt_field")
