"""Queries over right-to-left text, label maps, crops, geometry and files: each calls the library's own function."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quireflow.constants import MODEL_LABELS
from quireflow.functions import geometry as G, text
from quireflow.operators import crops, generate, matching, metrics, pairing
from quireflow.plans.commerce import _BOXES, SIDE, boxes, flat
from quireflow.plans.corpus import _PAIRS, pairs
from quireflow.plans.registry import query, table
from quireflow.sources import annotations as A, sinks

#: Latin letters of names become these, so that both engines see Arabic: letters that are folded, a mark, a tatweel.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "اإأآٱىئؤبتثجحخدذرزسشصـًعغ"
_ARABIC = f"SELECT p_partkey, translate(p_name, '{LATIN}', '{ARABIC}') AS t, translate(lower(p_brand), '{LATIN}', '{ARABIC}') AS brand FROM part"
_WORDS = r"list_filter(string_split(trim(regexp_replace({}, '[ \t\n]+', ' ', 'g')), ' '), lambda w: length(w) > 0)"
_TURNED = f"list_transform({_WORDS.format('t')}, lambda w: CASE WHEN regexp_matches(w, '[\\x{{0600}}-\\x{{06FF}}]') THEN list_aggregate(list_reverse(string_split(w, '')), 'string_agg', '') ELSE w END)"


def arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.translate("p_name", LATIN, ARABIC).alias("t"), F.translate(F.lower("p_brand"), LATIN, ARABIC).alias("brand"))


_NORMAL = "trim(regexp_replace(translate(regexp_replace(replace({}, 'ـ', ''), '[\\x{{064B}}-\\x{{065F}}]', '', 'g'), 'إأآٱىئؤ', 'ااااييو'), ' +', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORMAL.format('t')} AS normal, lower(trim(regexp_replace(nfc_normalize(t), ' +', ' ', 'g'))) AS field_form, regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') AS is_arabic FROM ({_ARABIC})")
def arabic_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return arabic(spark, sf_dir).select("p_partkey", text.normalize(t).alias("normal"), text.normalize_field(t).alias("field_form"), text.is_arabic(t).alias("is_arabic"))


@query(f"SELECT p_partkey, array_to_string(regexp_extract_all({_NORMAL.format('t')}, '[\\x{{0600}}-\\x{{06FF}}]+|[A-Za-z]+|[0-9]+(?:[./:-][0-9]+)*|[^ ]'), '|') AS tokens FROM ({_ARABIC})")
def arabic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arabic(spark, sf_dir).select("p_partkey", F.array_join(text.tokenize(F.col("t")), "|").alias("tokens"))


@query(f"SELECT p_partkey, array_to_string(list_reverse(x), ' ') AS logical, array_to_string(x, ' ') AS words_only, list_aggregate(list_reverse(string_split(t, '')), 'string_agg', '') AS reversed FROM (SELECT *, {_TURNED} AS x FROM ({_ARABIC}))")
def to_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual order brought back to logical order, with and without the order of words."""
    t = F.col("t")
    return arabic(spark, sf_dir).select("p_partkey", text.to_logical(t).alias("logical"), text.to_logical(t, reverse_order=False).alias("words_only"), text.reverse_text(t).alias("reversed"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(brand, '[\\x{{0600}}-\\x{{06FF}}]') AND NOT contains(t, brand) THEN brand || ' ' || t ELSE t END AS description FROM (SELECT p_partkey, t, CASE p_partkey % 3 WHEN 0 THEN brand WHEN 1 THEN 'plain' ELSE substr(t, 1, 3) END AS brand FROM ({_ARABIC}))")
def arabic_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the brands is Arabic, a third isn't, a third is part of the name already."""
    brand = F.when(F.col("p_partkey") % 3 == 0, F.col("brand")).when(F.col("p_partkey") % 3 == 1, "plain").otherwise(F.substring("t", 1, 3))
    return arabic(spark, sf_dir).select("p_partkey", text.with_brand(F.col("t"), brand).alias("description"))


@query(
    """
SELECT p_partkey, regexp_matches(p_type || p_partkey, '[0-9]') AS has_digit, replace(replace('B-' || p_brand || 'I-', 'B-', ''), 'I-', '') AS bare, printf('%.2f', p_retailprice::DECIMAL(18,2)) || ' ريال' AS money,
       printf('%.6f', p_size / 7) || ' ' || printf('%.6f', p_size / 3) AS coordinates, CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE (p_size % 3)::VARCHAR END AS class_name, substr(p_name, 1, 20) AS short,
       '.png' AS suffix, round(levenshtein(p_name, p_type) / greatest(length(p_type), 1), 9) AS char_ratio, round(levenshtein(p_name, p_type) / greatest(len(string_split(trim(regexp_replace(p_type, ' +', ' ', 'g')), ' ')), 1), 9) AS per_word
FROM part
"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit(0), F.lit("text"), F.lit(1), F.lit("table"))
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.has_digit(F.concat("p_type", F.col("p_partkey").cast("string"))).alias("has_digit"),
        text.strip_prefixes(F.concat(F.lit("B-"), "p_brand", F.lit("I-"))).alias("bare"),
        text.money(F.col("p_retailprice"), "ريال").alias("money"),
        text.coordinates(F.array(size / 7, size / 3)).alias("coordinates"),
        text.class_name(names, (size % 3).cast("int")).alias("class_name"),
        text.truncate(name, 20).alias("short"),
        text.suffix(F.concat(F.lit("a/b."), F.col("p_partkey").cast("string"), F.lit(".PNG"))).alias("suffix"),
        F.round(text.char_error_ratio(name, kind), 9).alias("char_ratio"),
        F.round(text.char_distance_per_word(name, kind), 9).alias("per_word"),
    )


def _annotation(b: Column) -> Column:
    x, y = b["x1"].cast("double"), b["y1"].cast("double")
    return F.struct(x.alias("x"), y.alias("y"), (b["x2"] - b["x1"]).cast("double").alias("width"), (b["y2"] - b["y1"]).cast("double").alias("height"))


def _points(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy])


def _quad() -> Column:
    """A skewed quadrangle in a box: its corners in another order."""
    b = F.col("bbox")
    return _points((b["x2"], b["y2"] - 3), (b["x1"], b["y1"] + 2), (b["x2"] - 5, b["y1"]), (b["x1"] + 4, b["y2"]))


_CUT = "least({n}, greatest(0, {v}))"
_CLIP = lambda x1, y1, x2, y2, r=lambda v: v: ", ".join(f"least({SIDE - 1}, greatest(0, {r(v)}))::INT AS {n}" for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2")))


@query(f"WITH {_BOXES} SELECT doc, pos, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM boxes")
def polygon_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).withColumn("h", G.hull(_quad())).select("doc", "pos", *flat("h"))


@query(f"WITH {_BOXES} SELECT doc, pos, {', '.join(f'least(1000, greatest(0, trunc({n} * 1000 / {SIDE})))::INT AS {n}' for n in ('x1', 'y1', 'x2', 'y2'))} FROM boxes")
def region_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a scale of 0..1000, truncated."""
    b = G.normalized(F.col("bbox"), F.lit(SIDE), F.lit(SIDE), truncate=True)
    return boxes(spark, sf_dir).withColumn("b", b).select("doc", "pos", *flat("b"))


@query(f"WITH {_BOXES} SELECT doc, pos, x1 / {SIDE} AS ax, round(y1 / {SIDE}, 9) AS ay, round(x2 / {SIDE}, 9) AS cx, round(y2 / {SIDE}, 9) AS cy FROM boxes".replace("x1 / 2000 AS", "round(x1 / 2000, 9) AS"))
def obb_from_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = G.obb_from_vertices(G.corners(_annotation(F.col("bbox"))), F.lit(SIDE), F.lit(SIDE))
    return boxes(spark, sf_dir).withColumn("o", o).select("doc", "pos", *[F.round(F.col("o")[i], 9).alias(n) for i, n in ((0, "ax"), (1, "ay"), (4, "cx"), (5, "cy"))])


_WARP = "SELECT *, x1::DOUBLE AS ax, y1 + 2.0::DOUBLE AS ay, x2 - 5.0::DOUBLE AS bx, y1::DOUBLE AS by_, x2::DOUBLE AS cx, y2 - 3.0::DOUBLE AS cy, x1 + 4.0::DOUBLE AS dx, y2::DOUBLE AS dy FROM boxes"


@query(
    f"""
WITH {_BOXES} SELECT doc, pos, ax, ay, bx, by_ AS "by", cx, cy, dx, dy, trunc(greatest(sqrt((cx - dx)**2 + (cy - dy)**2), sqrt((bx - ax)**2 + (by_ - ay)**2)))::INT AS width,
       trunc(greatest(sqrt((bx - cx)**2 + (by_ - cy)**2), sqrt((ax - dx)**2 + (ay - dy)**2)))::INT AS height FROM ({_WARP})
"""
)
def four_point_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in order, and the size of the upright image that they are warped to."""
    o = boxes(spark, sf_dir).withColumn("o", G.ordered_corners(_quad())).withColumn("s", G.warp_size(F.col("o")))
    names = (("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy"))
    return o.select("doc", "pos", *[F.col("o")[i][k].alias(n) for i, both in enumerate(names) for k, n in zip(("x", "y"), both)], "s.width", "s.height")


@query(f"WITH {_BOXES} SELECT doc, pos, CASE WHEN least(x2 - x1, y2 - y1) < 48 OR greatest(x2 - x1, y2 - y1) < 160 THEN 2 ELSE 1 END AS factor, x1 * 300 / 72 AS px, (y2 - y1) * 300 / 72 AS ph FROM boxes".replace("x1 * 300 / 72 AS px, (y2 - y1) * 300 / 72", "round(x1 * (300 / 72), 6) AS px, round((y2 - y1) * (300 / 72), 6)"))
def ocr_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor by which thin or small crops are enlarged, and boxes in points as pixels."""
    b = _annotation(F.col("bbox"))
    p = boxes(spark, sf_dir).withColumn("p", G.pdf_to_pixels(b))
    return p.select("doc", "pos", G.upscale(F.col("bbox.x2") - F.col("bbox.x1"), F.col("bbox.y2") - F.col("bbox.y1")).alias("factor"), F.round("p.x", 6).alias("px"), F.round("p.height", 6).alias("ph"))


@query(f"WITH {_BOXES} SELECT doc, pos, x, y, least(w, {SIDE} - x) AS width, least(h, {SIDE} - y) AS height FROM (SELECT doc, pos, greatest(0, least(x1::DOUBLE, {SIDE})) AS x, greatest(0, least(y1::DOUBLE, {SIDE})) AS y, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h FROM boxes) WHERE least(w, {SIDE} - x) > 0 AND least(h, {SIDE} - y) > 0")
def repaired_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clamped to the page; those of which nothing remains are left out."""
    r = G.repaired_bbox(_annotation(F.col("bbox")), F.lit(float(SIDE)), F.lit(float(SIDE)))
    return boxes(spark, sf_dir).withColumn("r", r).where("r is not null").select("doc", "pos", "r.x", "r.y", "r.width", "r.height")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as tokens of annotations: every fourth without text."""
    vertices = F.lit(None).cast("struct<vertices:array<struct<x:double,y:double>>>")
    word = F.when(F.col("pos") % 4 == 3, " ").otherwise(F.concat(F.lit("word number "), F.col("pos").cast("string"), F.lit(" of a page")))
    side = F.lit(float(SIDE))
    return boxes(spark, sf_dir).select(F.col("doc").cast("string").alias("stem"), "pos", _annotation(F.col("bbox")).alias("bbox"), vertices.alias("bounding_poly"), word.alias("text"), side.alias("width"), side.alias("height"), "label")


_CROPS = f"crops AS (SELECT doc::VARCHAR AS stem, pos, greatest(0, x1 - 5)::INT AS x1, greatest(0, y1 - 5)::INT AS y1, least({SIDE}, x2 + 5)::INT AS x2, least({SIDE}, y2 + 5)::INT AS y2 FROM boxes WHERE pos % 4 <> 3)"


@query(f"WITH {_BOXES}, {_CROPS}, kept AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pos) - 1 AS i FROM crops WHERE x2 > x1 AND y2 > y1) SELECT stem, i::INT AS crop_index, stem || '_' || i || '.png' AS crop, x1, y1, x2, y2 FROM kept")
def crop_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of one document after the other, numbered as far as they are kept."""
    return crops.crop_set(_tokens(spark, sf_dir)).select("stem", "crop_index", "crop", *flat("box"))


@query(f"WITH {_BOXES}, {_CROPS} SELECT (SELECT count(DISTINCT doc) FROM boxes) AS images, (SELECT count(*) FROM boxes) AS regions, count(*) AS valid, (SELECT count(*) FROM boxes) - count(*) AS skipped FROM crops WHERE x2 > x1 AND y2 > y1")
def preparation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    return crops.preparation_stats(tokens, crops.crop_set(tokens))


@query(f"WITH {_BOXES} SELECT doc::VARCHAR AS stem, pos, CASE WHEN pos % 4 = 3 THEN ' ' ELSE substr('word number ' || pos || ' of a page', 1, 20) END AS label, {_CLIP('x1', 'y1', 'x2', 'y2')} FROM boxes")
def overlay_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.overlay_boxes(_tokens(spark, sf_dir)).select("stem", "pos", "label", *flat("box"))


_OBB = " || ' ' || ".join(f"printf('%.6f', {v} / {SIDE}.0::DOUBLE)" for v in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"))


@query(f"WITH {_BOXES} SELECT doc::VARCHAR AS stem, CASE WHEN label = 'R' THEN 'train' ELSE 'val' END AS split, '0 ' || {_OBB} AS line FROM boxes")
def detection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of detection datasets: class and eight coordinates."""
    rows = _tokens(spark, sf_dir)
    split = F.when(F.col("label") == "R", "train").otherwise("val")
    obb = crops.entity_obb(rows.withColumn("stem", F.concat_ws("/", split, "stem")), "text").where("obb is not null")
    parts = obb.withColumn("split", F.split("stem", "/")[0]).withColumn("stem", F.split("stem", "/")[1])
    return sinks.obb_lines(parts).select("stem", "split", F.col("value").alias("line"))


_MAP = ", ".join(f"('{f}', '{label}')" for f, label in MODEL_LABELS.items())
_FIELD = "CASE doc_id % 4 WHEN 0 THEN 'invoice_ref' WHEN 1 THEN 'vat_rate' WHEN 2 THEN 'nothing_known' ELSE 'email' END"


@query(f"SELECT doc_id, label, model_label FROM (SELECT doc_id, {_FIELD} AS label FROM documents) JOIN (VALUES {_MAP}) m(gt_field, model_label) ON gt_field = label")
def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with the model's label; such without one are dropped."""
    return pairing.to_model_labels(table(spark, sf_dir, "documents").select("doc_id", F.expr(_FIELD).alias("label"))).select("doc_id", "label", "model_label")


@query("SELECT conv_id, a.turn AS pos, a.role AS truth, b.role AS predicted FROM conversations a JOIN (SELECT conv_id, turn - 1 AS turn, role FROM conversations WHERE turn > 0) b USING (conv_id, turn)")
def zipped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of equal place, up to the shorter sequence."""
    c = table(spark, sf_dir, "conversations")
    later = c.where("turn > 0").select("conv_id", (F.col("turn") - 1).alias("pos"), F.col("role").alias("predicted"))
    return matching.zipped(c.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("truth")), later, ["conv_id"]).select("conv_id", "pos", "truth", "predicted")


@query("SELECT doc_id AS id, lang AS kind, 0 AS part FROM documents UNION ALL SELECT page_id, NULL, 1 FROM pages")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    return pairing.concatenated(docs, table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE length(text) > 0) AS text FROM conversations GROUP BY conv_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.document_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(f"WITH {_PAIRS} SELECT field, round(avg((predicted = truth)::INT) * 100, 9) AS exact_percent, round(avg((lower(nfc_normalize(predicted)) = lower(nfc_normalize(truth)))::INT), 9) AS normalized_accuracy, count(*) AS support FROM pairs GROUP BY field")
def normalized_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.normalized_field_accuracy(pairs(spark, sf_dir))
    return out.select("field", F.round("exact_percent", 9).alias("exact_percent"), F.round("normalized_accuracy", 9).alias("normalized_accuracy"), "support")


@query("SELECT max(value) AS max_mb, round(avg(value), 6) AS mean_mb FROM events")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.memory_stats(table(spark, sf_dir, "events").select(F.col("value").alias("gpu_memory_mb")))
    return out.select("max_mb", F.round("mean_mb", 6).alias("mean_mb"))


@query("SELECT l_orderkey AS invoice, l_linenumber AS row_index, p_name AS description, l_quantity AS quantity, p_retailprice AS unit_price, round(p_retailprice::DECIMAL(18,2) * l_quantity::DECIMAL(10,0), 2)::DECIMAL(18,2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey")
def product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of invoices' product tables, with line totals."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    total = generate.line_total(F.col("p_retailprice"), F.col("l_quantity").cast("decimal(10,0)"))
    return generate.product_table(met.select(F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("row_index"), F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"), F.col("p_retailprice").alias("unit_price"), total.alias("total")))


def _folder(spark: SparkSession) -> str:
    """A new folder for files: where the session keeps checkpoints, which a cluster shares; in tests a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="quireflow-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("SELECT n_name || '.png' AS crop, r_name AS text, 'images/' || n_name || '.png' AS filename FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines written, read back, joined with the crops of their names, and laid out for trainers."""
    met = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _folder(spark)
    sinks.write_labels(met.select(F.concat("n_name", F.lit(".png")).alias("crop"), F.col("r_name").alias("text")), path)
    files = met.select(F.concat(F.lit("some/folder/"), "n_name", F.lit(".png")).alias("path"))
    read = pairing.crops_with_labels(files, A.read_labels(spark, path))
    laid = sinks.engine_layout(read).withColumnRenamed("words", "text")
    return read.select("crop", "text").join(laid.withColumn("crop", F.element_at(F.split("filename", "/"), -1)), ["crop", "text"])


@query("SELECT s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV report written twice, the second time over the first, and read back."""
    rows, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), _folder(spark)
    for _ in range(2):
        sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), _folder(spark)
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY md5('42:' || n_nationkey), n_nationkey) AS k, count(*) OVER () AS n FROM nation) SELECT n_nationkey, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r")
def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split data set written by folder and read back."""
    path = _folder(spark)
    sinks.write_splits(pairing.split(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey"), path)
    return spark.read.parquet(path).select("n_nationkey", F.col("split").cast("string").alias("split"))


_CATALOG = f"SELECT c_custkey, translate(c_name, 'abcdefghijklmnopqrstuvwxyz', '{ARABIC}') AS name, c_mktsegment AS category FROM customer WHERE c_custkey % 2 = 0"


@query(f"SELECT name, category FROM ({_CATALOG})")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog file written and read: rows without Arabic in their names are left out."""
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.translate("c_name", LATIN, ARABIC)).otherwise(F.lit("latin name")).alias("Item_Name"), F.lit("b").alias("Brand"), F.col("c_mktsegment").alias("class"))
    path = _folder(spark)
    from quireflow import schemas

    names = [c.split()[0].strip("`") for c in schemas.CATALOG.split(",")]
    sinks.write_csv(rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]), path)
    return A.read_catalog(spark, path).select("name", "category")


@query(f"WITH {_BOXES} SELECT doc, first_png FROM (SELECT doc, pos || CASE pos % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.bmp' END AS first_png, row_number() OVER (PARTITION BY doc ORDER BY pos % 3 <> 1, pos || CASE pos % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.bmp' END) AS r FROM boxes) WHERE r = 1")
def png_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("pos") % 3 == 0, ".jpg").when(F.col("pos") % 3 == 1, ".png").otherwise(".bmp")
    files = boxes(spark, sf_dir).select(F.col("doc").alias("stem"), suffix.alias("suffix"), F.concat(F.col("pos").cast("string"), suffix).alias("path"))
    return A.pick_png_first(files).select(F.col("stem").alias("doc"), F.col("path").alias("first_png"))
