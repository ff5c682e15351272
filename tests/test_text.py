import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text


def rows(spark, values, *columns):
    names = "pqrst"[: len(values[0])]
    return [tuple(r) for r in spark.createDataFrame(values, ", ".join(f"{n} string" for n in names)).select(*columns).collect()]


def plain_normal(t):
    t = unicodedata.normalize("NFKC", t or "").replace("ـ", "")
    t = re.sub("[ؐ-ًؚ-ٰٟۖ-ۭ]", "", t)
    t = t.translate(str.maketrans("إأآٱىئؤ", "ااااييو")).translate(str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"))
    return re.sub(r"\s+", " ", t).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SAMPLES = ["", None, "  a  b ", "إأآٱ ىئؤ", "مـرحبا", "كَتَبَ", "٣ ۳ 3", "ﬁ ½", "é", "ا،ب؛"]


def test_normalize(spark):
    got = rows(spark, [(s,) for s in SAMPLES], text.normalize(F.col("p")))
    assert [g[0] for g in got] == [plain_normal(s) for s in SAMPLES]


def test_tokenize(spark):
    got = rows(spark, [("سلام abc 12:30 x-1 !",)], text.tokenize(F.col("p")))
    assert got == [(["سلام", "abc", "12:30", "x", "-", "1", "!"],)]


@pytest.mark.parametrize("p,t,cer", [("", "", 0.0), ("a", "", 1.0), ("sitting", "kitten", 0.5), ("zzzzzzz", "ab", 3.5)])
def test_cer(spark, p, t, cer):
    assert rows(spark, [(p, t)], text.cer(F.col("p"), F.col("q")))[0][0] == cer


def test_edit_accuracy_is_clamped(spark):
    assert rows(spark, [("zzzzzzz", "ab"), ("ab", "ab"), ("", ""), ("a", "")], text.edit_accuracy(F.col("p"), F.col("q"))) == [(0.0,), (1.0,), (1.0,), (0.0,)]


def test_token_distance(spark):
    rng = random.Random(5)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randint(0, 8))), " ".join(rng.choices("abcd", k=rng.randint(0, 8)))) for _ in range(60)]
    got = rows(spark, pairs, text.token_distance(text.words(F.col("p")), text.words(F.col("q"))), text.wer(text.words(F.col("p")), text.words(F.col("q"))))
    for (p, q), (d, w) in zip(pairs, got):
        assert d == distance(p.split(), q.split())
        assert w == (d / len(q.split()) if q else float(bool(p)))


def test_logical_order(spark):
    got = rows(spark, [("ba 12",), ("سلام",), ("سلام 12",)], text.to_logical(F.col("p")), text.to_logical(F.col("p"), False))
    assert got == [("12 ba", "ba 12"), ("مالس", "مالس"), ("12 مالس", "مالس 12")]


def test_labels_and_names(spark):
    got = rows(spark, [("B-TOTAL-X", "/a/b/c.d.png")], text.field_of(F.col("p")), text.strip_prefixes(F.col("p")), text.stem(F.col("q")), text.suffix(F.col("q")))
    assert got == [("TOTAL-X", "TOTAL-X", "c.d", ".png")]
    assert rows(spark, [("O", ".hidden")], text.field_of(F.col("p")), text.stem(F.col("q"))) == [("O", ".hidden")]


def test_exact_match_and_money(spark):
    assert rows(spark, [("ABC ١", "abc 1"), ("a", "b")], text.exact_match(F.col("p"), F.col("q"))) == [(1.0,), (0.0,)]
    assert rows(spark, [("2.675",)], text.money(F.col("p").cast("decimal(18,3)"), "X")) == [("2.68 X",)]


def test_brand_and_placeholders(spark):
    got = rows(spark, [("شاي", "نور"), ("شاي نور", "نور"), ("شاي", "Nur"), ("شاي", None)], text.with_brand(F.col("p"), F.col("q")))
    assert got == [("نور شاي",), ("شاي نور",), ("شاي",), ("شاي",)]
    assert rows(spark, [("a {{k}} {{z}}",)], text.fill_placeholders(F.col("p"), F.create_map(F.lit("k"), F.lit("v")))) == [("a v {{z}}",)]
