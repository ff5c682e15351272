"""Key fields by rules: a token's words decide what the next token is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quireflow.constants import DATE, INVOICE, NAME, NUMBER, SELLER, TAX, TOTAL
from quireflow.functions import text
from quireflow.operators.ordering import strict_order

#: Keys of the result, the one that wins a token that several claim last.
KEYS = ("vendor_name", "invoice_id", "date", "total_amount")


def next_of(column: str, key: str, order: str) -> Column:
    """The value of the next token in the document."""
    return F.lead(column).over(Window.partitionBy(key).orderBy(order))


def vendor_flags(tokens: DataFrame, seller: Column, name: Column, has_next: Column, key: str, order: str) -> DataFrame:
    """tokens with `vendor`: whether the token introduces the vendor's name. A seller token arms the search; the first
    later name token that has a successor and names no seller fires and disarms it. The number of seller tokens so far
    is the group within which the first one fires."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    armed = tokens.withColumn("_s", F.coalesce(seller, F.lit(False))).withColumn("_g", F.sum(F.col("_s").cast("int")).over(w))
    able = armed.withColumn("_c", (F.col("_g") > 0) & ~F.col("_s") & F.coalesce(name, F.lit(False)) & has_next)
    sofar = Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return able.withColumn("vendor", F.col("_c") & (F.sum(F.col("_c").cast("int")).over(sofar) == 1)).drop("_s", "_g", "_c")


def tag(tokens: DataFrame, key: str = "stem", pos: str = "pos", variant: int = 2) -> DataFrame:
    """tokens(key, pos, text, bbox) in strict reading order, with reading_order, text_logical, label (null: none) and
    value, the label's value in the document.

    Variant 1 looks for words in the reversed text too, keeps the order of words in values, takes "number" for a mark
    of the invoice's number and keeps values other than the vendor's as they are. Variant 2 looks in the logical text.
    """
    rows = strict_order(tokens, key, F.col("bbox.y"), F.col("bbox.x"), pos)
    logical = text.to_logical(F.col("text"), reverse_order=variant == 2)
    back = F.reverse("text")
    rows = rows.withColumn("text_logical", logical).withColumn("_back", back)
    within = lambda c, *needles: F.greatest(*[F.contains(c, F.lit(n)) for n in needles], F.lit(False))
    if variant == 1:
        either = lambda n: within(F.col("text_logical"), n) | within(F.col("_back"), n)
        seller, name = either(SELLER), either(NAME)
        invoice, date, total = within(F.col("_back"), TAX, INVOICE, NUMBER), within(F.col("_back"), DATE), within(F.col("_back"), TOTAL)
    else:
        seller, name = within(F.col("text_logical"), SELLER), within(F.col("text_logical"), NAME)
        invoice, date, total = within(F.col("text_logical"), TAX, INVOICE), within(F.col("text_logical"), DATE), within(F.col("text_logical"), TOTAL)
    at = "reading_order"
    following = next_of("text", key, at)
    rows = rows.withColumn("_next", following)
    rows = vendor_flags(rows, seller, name, F.col("_next").isNotNull(), key, at)
    digit, dash = F.coalesce(text.has_digit(F.col("_next")), F.lit(False)), F.coalesce(F.contains("_next", F.lit("-")), F.lit(False))
    rows = rows.withColumn("_marks", F.filter(F.array(F.when(F.col("vendor"), KEYS[0]), F.when(invoice & digit, KEYS[1]), F.when(date & dash, KEYS[2]), F.when(total & digit, KEYS[3])), lambda m: m.isNotNull()))
    before = F.lag("_marks").over(Window.partitionBy(key).orderBy(at))
    out = rows.withColumn("_own", F.coalesce(before, F.array().cast("array<string>"))).withColumn("label", F.try_element_at("_own", F.lit(-1)))
    return out.withColumn("keys", F.col("_own")).drop("_back", "_next", "vendor", "_marks", "_own")


def key_information(tagged: DataFrame, key: str = "stem", variant: int = 2) -> DataFrame:
    """(key, key_information): each document's map from key to value, of several the last one in reading order."""
    value = F.col("text_logical") if variant == 2 else F.when(F.col("k") == KEYS[0], F.col("text_logical")).otherwise(F.col("text"))
    marks = tagged.select(key, "reading_order", "text", "text_logical", F.explode("keys").alias("k")).withColumn("v", value)
    last = Window.partitionBy(key, "k").orderBy(F.col("reading_order").desc())
    best = marks.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("key_information"))


def rewrite(annotations: DataFrame, tagged: DataFrame, info: DataFrame) -> DataFrame:
    """Annotations with their tokens in reading order, labels, logical texts, and key_information."""
    sorted_ = F.array_sort(F.collect_list(F.struct("reading_order", F.struct("id", "text", "bbox", "bounding_poly", "direction", "line_id", "confidence", "label", "text_logical").alias("t"))))
    tokens = tagged.groupBy("stem").agg(F.transform(sorted_, lambda x: x["t"]).alias("_tokens"))
    out = annotations.drop("key_information").join(tokens, "stem", "left").join(info, "stem", "left")
    return out.withColumn("entities", F.col("entities").withField("ocr_text", F.coalesce("_tokens", "entities.ocr_text"))).withColumn("key_information", F.coalesce("key_information", F.create_map().cast("map<string,string>"))).drop("_tokens")
