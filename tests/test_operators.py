import json
import random

import numpy as np
from pyspark.sql import functions as F
from test_text import distance

from quireflow.functions import geometry as G, text
from quireflow.operators import augment, crops, generate, kie, matching, metrics, ordering, pages, pairing
from quireflow.sources import annotations as A, sinks
from quireflow.streaming import annotations as S

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def random_boxes(rng, n, size=60, side=300):
    return [(x := rng.randint(0, side), y := rng.randint(0, side), x + rng.randint(1, size), y + rng.randint(1, size)) for _ in range(n)]


def plain_iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union else 0.0


def plain_reading_order(boxes, rtl=True):
    near = max(8, int(np.median([max(1, b[3] - b[1]) for b in boxes]) * 0.6))
    mid = lambda i: ((boxes[i][1] + boxes[i][3]) / 2, (boxes[i][0] + boxes[i][2]) / 2)
    lines = []
    for i in sorted(range(len(boxes)), key=mid):
        line = next((l for l in lines if abs(mid(i)[0] - l[0]) <= near), None)
        if line is None:
            lines.append([mid(i)[0], [i]])
        else:
            line[1].append(i)
            line[0] = float(np.mean([mid(j)[0] for j in line[1]]))
    out = []
    for _, own in sorted(lines, key=lambda l: l[0]):
        out += sorted(own, key=lambda i: mid(i)[1], reverse=rtl)
    return out


def test_reading_order_against_a_loop(spark):
    rng = random.Random(1)
    docs = {d: random_boxes(rng, rng.randint(1, 40), 40, 200) for d in range(40)}
    rows = [(d, i, b) for d, boxes in docs.items() for i, b in enumerate(boxes)]
    got = ordering.line_order(spark.createDataFrame(rows, f"doc int, pos int, bbox {BOX}"), "doc").collect()
    for d, boxes in docs.items():
        mine = [r["pos"] for r in sorted((r for r in got if r["doc"] == d), key=lambda r: r["reading_order"])]
        assert mine == plain_reading_order(boxes)


def test_dedup_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for d in range(20):
        for i, b in enumerate(random_boxes(rng, 25, 9, 6)):
            rows.append((d, i, b, rng.choice(["a", "b"]), rng.choice([0.2, 0.5, 0.9])))
    got = {(r["doc"], r["pos"]) for r in ordering.dedup_tokens(spark.createDataFrame(rows, f"doc int, pos int, bbox {BOX}, text string, ocr_confidence double")).collect()}
    expected = set()
    for d in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: -r[4]):
            if not any(k[3] == r[3] and plain_iou(k[2], r[2]) >= 0.8 for k in kept):
                kept.append(r)
        expected |= {(d, r[1]) for r in kept}
    assert got == expected


def test_greedy_align_against_a_loop(spark):
    rng = random.Random(3)
    truth, predicted = ([(d, i, b) for d in range(25) for i, b in enumerate(random_boxes(rng, 12, 60, 120))] for _ in range(2))
    got = {(r["doc"], r["pos"], r["pred_pos"]) for r in matching.greedy_align(spark.createDataFrame(truth, f"doc int, pos int, bbox {BOX}"), spark.createDataFrame(predicted, f"doc int, pred_pos int, bbox {BOX}")).collect()}
    expected = set()
    for d in range(25):
        used = set()
        for _, i, b in [t for t in truth if t[0] == d]:
            best, at = 0.0, None
            for _, j, c in [p for p in predicted if p[0] == d]:
                if j not in used and plain_iou(c, b) > best:
                    best, at = plain_iou(c, b), j
            if at is not None and best >= 0.1:
                used.add(at)
                expected.add((d, i, at))
    assert got == expected


def plain_ap(predicted, truth, threshold):
    """Average precision by a plain loop over (doc, pos, box, confidence) and (doc, pos, box)."""
    used, flags, ious = set(), [], []
    for d, j, b, _ in sorted(predicted, key=lambda p: (-p[3], p[0], p[1])):
        best, at = 0.0, None
        for e, i, t in truth:
            if e == d and (e, i) not in used and plain_iou(b, t) > best:
                best, at = plain_iou(b, t), (e, i)
        ious.append(best)
        hit = at is not None and best >= threshold
        if hit:
            used.add(at)
        flags.append(int(hit))
    hits = np.cumsum(flags)
    precision = hits / np.arange(1, len(flags) + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return float((envelope * flags).sum() / len(truth)), float(np.mean(ious))


def test_detection_ap_against_a_loop(spark):
    rng = random.Random(4)
    truth = [(d, i, b) for d in range(15) for i, b in enumerate(random_boxes(rng, 8, 60, 100))]
    predicted = [(d, i, (b[0] + rng.randint(-6, 6), b[1], b[2] + 3, b[3]), rng.random()) for d, i, b in truth if rng.random() < 0.8]
    m = matching.detection_metrics(spark.createDataFrame(predicted, f"doc int, pred_pos int, bbox {BOX}, confidence double"), spark.createDataFrame(truth, f"doc int, pos int, bbox {BOX}"))
    for r in m.collect():
        ap, mean = plain_ap(predicted, truth, r["threshold"])
        assert abs(r["ap"] - ap) < 1e-9 and abs(r["mean_iou"] - mean) < 1e-9
    both = matching.mean_average_precision(m).first()
    assert 0 <= both["map_50_95"] <= both["map_50"] <= 1


def test_detection_ap_of_equal_confidences_and_many_thresholds(spark):
    """Several longs of hits, few bands with ties, predictions that share true boxes, and one without a document."""
    rng = random.Random(5)
    truth = [(d, i, b) for d in range(30) for i, b in enumerate(random_boxes(rng, 8, 60, 100))]
    predicted = [(d, i, (b[0] + rng.randint(-9, 9), b[1], b[2] + 3, b[3]), rng.choice([0.2, 0.5, 0.9])) for d, i, b in truth if rng.random() < 0.8] + [(None, 0, (0, 0, 50, 50), 0.1)]
    thresholds = tuple(i / 70 for i in range(1, 70))
    frames = spark.createDataFrame(predicted, f"doc int, pred_pos int, bbox {BOX}, confidence double"), spark.createDataFrame([*truth, (None, 0, (0, 0, 50, 50))], f"doc int, pos int, bbox {BOX}")
    plain = [(p[0] if p[0] is not None else -1, *p[1:]) for p in predicted]
    got = {r["threshold"]: r for r in matching.detection_metrics(*frames, thresholds).collect()}
    assert sorted(got) == sorted(thresholds)
    for t in thresholds[::6]:
        ap, mean = plain_ap(plain, [*truth, (-2, 0, (0, 0, 50, 50))], t)
        assert abs(got[t]["ap"] - ap) < 1e-9 and abs(got[t]["mean_iou"] - mean) < 1e-9 and got[t]["n"] == len(predicted)
    rows = matching.detections_matched(*frames, thresholds)
    assert rows.count() == len(predicted) * len(thresholds) and rows.where("tp = 1").count() == sum(round(r["recall"] * (len(truth) + 1)) for r in got.values())


def test_detection_ap_shuffles_little(spark):
    """Boxes are shuffled once and a prediction once more, not its thresholds."""
    from quireflow.plans import commerce

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    at = written()
    assert commerce.detection_ap(spark, "/root/testdata/sf0.01").count() == 10
    assert written() - at < 6_000_000


def test_perfect_ap(spark):
    truth = spark.createDataFrame([(1, 0, (0, 0, 9, 9)), (1, 1, (20, 20, 30, 30))], f"doc int, pos int, bbox {BOX}")
    p = truth.withColumnRenamed("pos", "pred_pos").withColumn("confidence", F.lit(0.9))
    assert {r["ap"] for r in matching.detection_metrics(p, truth).collect()} == {1.0}
    assert {r["ap"] for r in matching.detection_metrics(p, truth.limit(0)).collect()} == {0.0}


def test_bio(spark):
    tags = ["B-A", "I-A", "O", "I-A", "I-B", "B-B"]
    df = spark.createDataFrame([(1, i, t, f"w{i}", float(i), (i, i, i + 1, i + 1)) for i, t in enumerate(tags)], f"doc int, token_index int, label string, text string, lilt_score double, bbox {BOX}")
    e = pages.entities(df.withColumn("bbox_norm", F.col("bbox"))).orderBy("entity").collect()
    assert [(r["field"], r["token_indices"]) for r in e] == [("A", [0, 1]), ("A", [3]), ("B", [4]), ("B", [5])]
    assert e[0]["text"] == "w0 w1" and e[0]["score"] == 0.5 and tuple(e[0]["bbox"]) == (0, 0, 2, 2)
    assert {r["gt_field"] for r in pages.field_values(pages.entities(df.withColumn("bbox_norm", F.col("bbox")))).collect()} == {"a", "b"}


def kie_rows(spark, words):
    return spark.createDataFrame([("d", i, w[::-1] if any("؀" <= c <= "ۿ" for c in w) else w, (0.0, float(i), 1.0, 1.0)) for i, w in enumerate(words)], "stem string, pos int, text string, bbox struct<x:double,y:double,width:double,height:double>")


def test_kie(spark):
    words = ["البائع", "شيء", "اسم", "محل", "اسم", "آخر", "فاتورة", "A12", "تاريخ", "2024-01-02"]
    for variant in (1, 2):
        tagged = kie.tag(kie_rows(spark, words), variant=variant)
        labels = {r["pos"]: r["label"] for r in tagged.collect() if r["label"]}
        assert labels == {3: "vendor_name", 7: "invoice_id", 9: "date"}
        assert kie.key_information(tagged, variant=variant).first()["key_information"] == {"vendor_name": "محل", "invoice_id": "A12", "date": "2024-01-02"}


def test_split_sizes(spark):
    for n, sizes in ((10, (7, 2, 1)), (3, (2, 0, 1)), (0, (0, 0, 0))):
        df = pairing.split(spark.range(n).select(F.col("id").alias("stem")))
        counts = {r["split"]: r["n"] for r in pairing.split_counts(df).collect()}
        assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes


def annotation(tokens, fields=(), size=(1000.0, 500.0)):
    boxes = [{"id": f"t{i}", "text": t, "bbox": {"x": 10.0 + 100 * i, "y": 10.0, "width": 80.0, "height": 20.0}, "confidence": 0.9} for i, t in enumerate(tokens)]
    return {"version": "1", "image_size": {"width": size[0], "height": size[1]}, "entities": {"ocr_text": boxes, "table": [{"bbox": {"x": 0.0, "y": 50.0, "width": 100.0, "height": 100.0}, "confidence": 0.8}], "kie_fields": list(fields), "line_items": [{"item_index": 0, "fields": {"qty": {"text": "2"}}}]}}


def write(tmp_path, docs):
    folder = tmp_path / "ann"
    folder.mkdir()
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(folder)


def test_annotations_round_trip(spark, tmp_path):
    fields = [{"label": "total", "normalized_value": "12", "token_ids": ["t1", "t0"]}, {"label": "other", "text": "x"}]
    path = write(tmp_path, {"a": annotation(["one", "two", ""], fields), "bad": "{nope", "flat": annotation(["x"], size=(0.0, 5.0))})
    valid, rejected = A.split_valid(A.read_annotations(spark, path).cache())
    assert [r["stem"] for r in valid.collect()] == ["a"]
    assert {r["stem"]: r["reason"] for r in rejected.collect()} == {"bad": "not JSON of the schema", "flat": "image without area"}
    tokens = pages.ground_truth_tokens(valid)
    assert [r["id"] for r in tokens.orderBy("reading_order").collect()] == ["t2", "t1", "t0"]
    labelled = pages.ground_truth_labels(tokens, A.kie_fields(valid))
    assert {r["id"]: r["token_label"] for r in labelled.collect()} == {"t0": "I-TOTAL", "t1": "B-TOTAL", "t2": "O"}
    assert [(r["label"], r["value"]) for r in pages.ground_truth_fields(valid).orderBy("label").collect()] == [("other", "x"), ("total", "12")]
    assert A.line_items(valid).first()["text"] == "2"
    assert crops.crop_set(A.tokens(valid)).orderBy("crop_index").first()["crop"] == "a_0.png"
    assert crops.detection_labels(valid, pairing.split(valid.select("stem"))).count() == 4
    assert crops.preparation_stats(A.tokens(valid), crops.crop_set(A.tokens(valid))).first()["skipped"] == 1
    assert crops.overlay_boxes(A.tokens(valid)).count() == 3


def test_rotation_of_annotations(spark, tmp_path):
    valid, _ = A.split_valid(A.read_annotations(spark, write(tmp_path, {"a": annotation(["w"])})).cache())
    turned = augment.rotate(valid, F.lit(0.0)).first()
    t = turned["entities"]["ocr_text"][0]
    assert t["bbox"] is None and tuple(t["bounding_poly"]["vertices"][0]) == (10.0, 10.0) and abs(t["confidence"] - 0.81) < 1e-9
    assert turned["entities"]["table"][0]["confidence"] == 0.8
    big = valid.withColumn("image_size", F.struct(F.lit(8000.0).alias("width"), F.lit(2000.0).alias("height")))
    assert augment.rescale(big).first()["entities"]["ocr_text"][0]["bbox"]["x"] == 5.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "x"), ("b.png", "y")], "crop string, text string")
    sinks.write_labels(rows, str(tmp_path / "labels"))
    back = A.read_labels(spark, str(tmp_path / "labels"))
    assert sorted(map(tuple, back.collect())) == [("a.png", "x"), ("b.png", "y")]
    odd = spark.createDataFrame([("a.png\tx\ty",), ("a.png",), ("c\td",)], "value string")
    assert A.labels(odd).count() == 1
    sinks.write_csv(rows, str(tmp_path / "csv"))
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    assert sinks.engine_layout(rows).first()["filename"].startswith("images/")
    assert "nc: 2" in sinks.dataset_yaml("/d", ["text", "table"])
    assert "cer: 0.5000" in sinks.summary(spark.range(1).select(F.lit(0.5).alias("cer")))
    obb = spark.createDataFrame([("train", "s", 0, [0.1] * 8), ("train", "t", 1, None)], "split string, stem string, class_id int, obb array<double>")
    sinks.write_obb(sinks.obb_lines(obb), str(tmp_path / "obb"))
    assert spark.read.text(str(tmp_path / "obb")).first()["value"] == "0 " + " ".join(["0.100000"] * 8)


def test_generation_is_repeatable(spark):
    a, b = (sorted(map(str, generate.invoices(spark, 12).collect())) for _ in range(2))
    assert a == b and len(a) == 12
    for r in generate.invoices(spark, 12).collect():
        lines = [p["total_numeric"] for p in r["products"]]
        assert 3 <= len(lines) <= 6 and sum(lines) == r["subtotal"] and r["total"] == r["subtotal"] + r["tax"]
    cat = A.catalog(spark.createDataFrame([("شاي", "نور", "Water", "1", "u", "p"), ("tea", "x", "y", "1", "u", "p")], "Item_Name string, Brand string, class string, Weight string, Unit string, Pack string"))
    items = generate.products_from_catalog(generate.invoice_numbers(spark, 5), cat)
    assert {r["description"] for r in items.collect()} == {"نور شاي"} and items.where("unit_price_numeric < 5 or unit_price_numeric > 30").count() == 0
    assert generate.random_products(generate.invoice_numbers(spark, 5), legacy=True).count() >= 15


def test_page_pipeline(spark):
    rows = [("d", 0, "b a", (0, 0, 100, 20), 0.9), ("d", 1, "a", (50, 0, 100, 20), 0.5), ("d", 2, "z", (0, 50, 10, 60), 0.01)]
    t = spark.createDataFrame(rows, f"doc string, pos long, text string, bbox {BOX}, ocr_confidence double")
    got = pages.clean_tokens(t, direction="ltr").orderBy("reading_order").collect()
    assert [r["text"] for r in got] == ["b", "a"]
    fields = spark.createDataFrame([("d", "f", (0, 0, 100, 20))], f"doc string, label string, bbox {BOX}")
    assert pages.ocr_texts(pages.clean_tokens(t).drop("reading_order"), fields, direction="ltr").first()["text"] == "b a"
    assert pages.with_fallback(t.where("pos = 0"), t.where("pos > 0"), ["doc"]).count() == 1


def test_run_stats(spark):
    r = metrics.run_stats(spark.createDataFrame([(1.0,), (3.0,)], "seconds double")).first()
    assert (r["mean"], r["std"], r["throughput"]) == (2.0, 1.0, 0.5)
    assert metrics.memory_stats(spark.createDataFrame([(1.0,), (None,)], "gpu_memory_mb double")).first()["max_mb"] == 1.0


def test_histogram_of_equal_values(spark):
    assert [tuple(r) for r in metrics.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).collect()] == [(1, 2)]
    assert metrics.histogram(spark.createDataFrame([], "v double"), "v", 5).count() == 0


def test_concatenated_rates_have_a_bound(spark):
    p = spark.createDataFrame([(1, "ab", "abc"), (2, "x", "y")], "o int, predicted string, truth string")
    assert metrics.global_error_rates(p, "o").first()["cer"] == 2 / 5
    assert metrics.global_error_rates(p, "o", most=2).first()["cer"] is None


def test_edit_distance_in_blocks():
    rng = random.Random(31)
    for block in (1, 3, 8, 1 << 13):
        for _ in range(60):
            a, b = ("".join(rng.choices("abé", k=rng.randint(0, 30))) for _ in range(2))
            assert text.edit_distance(a, b, block) == text.edit_distance(list(b), list(a), block) == distance(a, b)


def test_concatenated_rates_of_long_groups(spark):
    rng = random.Random(32)
    rows = [(g, i, " ".join(rng.choices("abcd", k=k)), " ".join(rng.choices("abcd", k=k))) for g in range(4) for i, k in enumerate((0, 9, 20))]
    p = spark.createDataFrame(rows, "g int, o int, predicted string, truth string")
    got = lambda **how: sorted(tuple(r) for r in metrics.global_error_rates(p, "o", by=["g"], **how).collect())
    assert got(long=0) == got() and all(c > 0 and w > 0 for _, c, w in got())
    # beyond the former bound of 100 000 characters, from which results were null
    base = "".join(rng.choices("abcdefgh ", k=1000)).strip()
    big = spark.createDataFrame([(i, base + "x", base) for i in range(110)], "o int, predicted string, truth string")
    r, n = metrics.global_error_rates(big, "o").first(), len(text_squeezed(" ".join([base] * 110)))
    assert r["cer"] == 110 / n and r["wer"] is not None and 0 < r["wer"] < 1
    assert metrics.global_error_rates(big, "o", most=100_000).first()["cer"] is None


def text_squeezed(t):
    return " ".join(t.split())


def test_stream(spark, tmp_path):
    path = write(tmp_path, {"a": annotation(["w"]), "b": annotation(["x", "y"])})
    q = S.run_each(S.stream_annotations(spark, path), A.tokens, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_boxes_of_words(spark):
    df = spark.createDataFrame([(1, "aa bb", (0, 0, 100, 10)), (2, "سل ام", (0, 0, 100, 10)), (3, "one", (3, 3, 9, 9)), (4, "  ", (0, 0, 1, 1))], f"id int, text string, bbox {BOX}")
    got = {(r["id"], r["piece_no"]): tuple(r["piece_box"]) for r in ordering.split_boxes(df).collect()}
    assert got == {(1, 0): (0, 0, 50, 10), (1, 1): (50, 0, 100, 10), (2, 0): (50, 0, 100, 10), (2, 1): (0, 0, 50, 10), (3, 0): (3, 3, 9, 9)}
    assert spark.range(1).select(G.center_inside(G.box(*map(F.lit, (0, 0, 4, 4))), G.box(*map(F.lit, (2, 2, 9, 9))))).first()[0]
