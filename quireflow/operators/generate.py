"""Generating catalogs' line items and invoices. Every draw is a hash of seed, row and purpose, so any part of the data
can be made again by itself, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quireflow.constants import CURRENCY, PRODUCTS_PER_INVOICE, PRODUCTS_SPREAD, VAT_RATE
from quireflow.functions import text

# Prices from and to, by category.
PRICE_BANDS = ((("Water", "Soft Drinks & Juices"), 5, 30), (("Vegetables & Fruits",), 10, 50), (("Cleaning Supplies",), 30, 200))
PRICE_BAND_WITHIN = (("Tins", "Rice"), 15, 80)
PRICE_OTHER = (5, 500)

#: Vocabulary of our own for products without a catalog.
TYPES = ("أرز", "سكر", "طحين", "زيت", "شاي", "قهوة", "حليب", "جبن", "عدس", "ملح", "تمر", "عسل", "صابون", "مناديل", "معجون", "خل", "زبدة", "فول", "حمص", "مكرونة")
BRANDS = ("السنبلة", "الواحة", "النخيل", "الربوة", "السهل", "الميناء", "الروضة", "القمة")
COLOURS = ("أبيض", "أسود", "أحمر", "أخضر", "أزرق", "أصفر", "بني")
ADJECTIVES = ("فاخر", "طازج", "طبيعي", "كبير", "صغير", "ممتاز", "خفيف", "نقي")
PACKS = ("كيس", "علبة", "زجاجة", "عبوة", "باكو")
UNITS = ("جم", "مل", "كجم", "")
COMPANIES = ("شركة السهل للتجارة", "مؤسسة الروضة", "شركة الميناء للتوريد", "مجموعة القمة", "دار الواحة")
NOTES = ("التسليم في موقع العميل.", "الدفع عند الاستلام.", "تراجع الكميات قبل التوقيع.", "لا يشمل السعر النقل.", "تحفظ البضاعة في مكان جاف.", "الفاتورة صالحة لشهر.")


def uniform(*parts) -> Column:
    """A number in [0, 1) out of the parts' hash."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def draw(low: int, high: int, *parts) -> Column:
    """An integer from low to high."""
    return (F.floor(uniform(*parts) * (high - low + 1)) + low).cast("int")


def choice(values: tuple[str, ...], *parts) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), draw(1, len(values), *parts))


def price_band(category: Column) -> Column:
    """(low, high) of a category's prices."""
    band = lambda lo, hi: F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"))
    out = None
    for names, low, high in PRICE_BANDS:
        out = F.when(category.isin(*names), band(low, high)) if out is None else out.when(category.isin(*names), band(low, high))
    names, low, high = PRICE_BAND_WITHIN
    within = F.coalesce(F.greatest(*[F.contains(category, F.lit(n)) for n in names]), F.lit(False))
    return out.when(within, band(low, high)).otherwise(band(*PRICE_OTHER))


def price(category: Column, *parts) -> Column:
    """A price within the category's band, two decimals."""
    band = price_band(category)
    return F.round(band["low"] + uniform(*parts) * (band["high"] - band["low"]), 2).cast("decimal(18,2)")


def line_total(price_: Column, quantity: Column) -> Column:
    return F.round(price_.cast("decimal(18,2)") * quantity, 2).cast("decimal(18,2)")


def product_count(*parts, base: int = PRODUCTS_PER_INVOICE, spread: float = PRODUCTS_SPREAD) -> Column:
    """How many products an invoice has: the whole part of base times 1 ± spread."""
    return (F.lit(float(base)) * (1 - spread + 2 * spread * uniform(*parts))).cast("int")


def _formatted(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("total_numeric", line_total(F.col("unit_price_numeric"), F.col("quantity")))
    return out.withColumn("unit_price", text.money(F.col("unit_price_numeric"), CURRENCY)).withColumn("total", text.money(F.col("total_numeric"), CURRENCY))


def slots(invoices: DataFrame, seed: int) -> DataFrame:
    """(invoice, row_index): places for products."""
    return invoices.select("invoice", F.explode(F.sequence(F.lit(0), product_count(seed, F.col("invoice"), "count") - 1)).alias("row_index"))


def products_from_catalog(invoices: DataFrame, catalog: DataFrame, seed: int = 42) -> DataFrame:
    """Line items of invoices(invoice) out of catalog(name, brand, category, unit, pack), drawn with replacement.

    Catalog rows get dense numbers in the order of their names; each place draws a number and joins the row.
    """
    n = catalog.count()
    from pyspark.sql import Window

    dense = catalog.withColumn("_n", F.row_number().over(Window.orderBy("name", "brand", "category", "pack", "unit")) - 1)
    picked = slots(invoices, seed).withColumn("_n", draw(0, max(n - 1, 0), seed, F.col("invoice"), F.col("row_index"), "product")).join(dense, "_n")
    rows = picked.select("invoice", "row_index", text.with_brand(F.col("name"), F.col("brand")).alias("description"), draw(1, 10, seed, F.col("invoice"), F.col("row_index"), "quantity").alias("quantity"), price(F.col("category"), seed, F.col("invoice"), F.col("row_index"), "price").alias("unit_price_numeric"), F.coalesce("pack", F.lit("")).alias("pack"), F.coalesce("unit", F.lit("")).alias("unit"))
    return _formatted(rows)


def random_products(invoices: DataFrame, seed: int = 42, legacy: bool = False) -> DataFrame:
    """Line items from our own vocabulary, in four styles of names. legacy: prices up to 5000, quantities up to 50,
    adjectives in names, no packs or units."""
    at = lambda purpose: (seed, F.col("invoice"), F.col("row_index"), purpose)
    t, b, c, a = choice(TYPES, *at("type")), choice(BRANDS, *at("brand")), choice(COLOURS, *at("colour")), choice(ADJECTIVES, *at("adjective"))
    style = draw(1, 4, *at("style"))
    parts = [(b, t, a), (t, c, a), (b, c, t), (t, a)] if legacy else [(b, t), (t, c), (b, t), (t,)]
    name = F.when(style == 1, F.concat_ws(" ", *parts[0])).when(style == 2, F.concat_ws(" ", *parts[1])).when(style == 3, F.concat_ws(" ", *parts[2])).otherwise(F.concat_ws(" ", *parts[3]))
    cost = F.round(5 + uniform(*at("price")) * ((5000 if legacy else 500) - 5), 2).cast("decimal(18,2)")
    rows = slots(invoices, seed).select("invoice", "row_index", name.alias("description"), draw(1, 50 if legacy else 10, *at("quantity")).alias("quantity"), cost.alias("unit_price_numeric"))
    if not legacy:
        rows = rows.withColumn("pack", choice(PACKS, *at("pack"))).withColumn("unit", choice(UNITS, *at("unit")))
    return _formatted(rows)


def invoice_totals(items: DataFrame, key: str, price_: Column, quantity: Column, rate: str = VAT_RATE) -> DataFrame:
    """(key, subtotal, tax, total) in decimals: the tax is rounded to cents once for each invoice."""
    sub = F.sum((price_.cast("decimal(18,2)") * quantity.cast("decimal(10,0)")).cast("decimal(28,2)"))
    out = items.groupBy(key).agg(sub.cast("decimal(28,2)").alias("subtotal"))
    out = out.withColumn("tax", F.round(F.col("subtotal") * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(28,2)"))
    return out.withColumn("total", (F.col("subtotal") + F.col("tax")).cast("decimal(28,2)"))


def invoice_numbers(spark: SparkSession, n: int) -> DataFrame:
    """(invoice): padded numbers from 1 to n."""
    return spark.range(1, n + 1).select(F.lpad(F.col("id").cast("string"), len(str(n)), "0").alias("invoice"))


def invoices(spark: SparkSession, n: int, seed: int = 42, catalog: DataFrame | None = None) -> DataFrame:
    """n invoices with their products and totals, and every text field of a template."""
    ids = invoice_numbers(spark, n)
    items = random_products(ids, seed) if catalog is None else products_from_catalog(ids, catalog, seed)
    totals = invoice_totals(items, "invoice", F.col("unit_price_numeric"), F.col("quantity"))
    listed = items.groupBy("invoice").agg(F.array_sort(F.collect_list(F.struct("row_index", *[c for c in items.columns if c not in ("invoice", "row_index")]))).alias("products"))
    at = lambda purpose: (seed, F.col("invoice"), purpose)
    digits = lambda k, purpose: F.lpad(draw(0, 10**k - 1, *at(purpose)).cast("string"), k, "0")
    long_digits = lambda purpose: F.concat(digits(6, purpose), digits(5, purpose + "2"))
    fields = {
        "invoice_ref": F.concat(F.lit("INV-"), digits(4, "ref"), F.lit("-2024")),
        "company_name": choice(COMPANIES, *at("company")),
        "seller_name": choice(COMPANIES, *at("seller")),
        "seller_address": F.concat_ws(" ", F.lit("شارع"), draw(1, 99, *at("street")).cast("string")),
        "seller_vat_number": long_digits("vat"),
        "issue_datetime": F.date_add(F.lit("2024-01-01").cast("date"), draw(0, 365, *at("date"))).cast("string"),
        "email": F.concat(F.lit("mail"), digits(3, "mail"), F.lit("@example.com")),
        "website": F.concat(F.lit("shop"), digits(3, "site"), F.lit(".example")),
        "phone_number": F.concat(F.lit("05"), digits(8, "phone")),
        "fax_number": F.concat(F.lit("01"), digits(7, "fax")),
        "recipient_name": choice(COMPANIES, *at("recipient")),
        "recipient_vat_number": long_digits("rvat"),
        "recipient_phone": F.concat(F.lit("05"), digits(8, "rphone")),
        "shipping_address": F.concat_ws(" ", F.lit("حي"), draw(1, 40, *at("ship")).cast("string")),
        "special_instructions": F.concat_ws(" ", choice(NOTES[:3], *at("note")), choice(NOTES[3:], *at("note2"))),
    }
    out = ids.select("invoice", *[v.alias(k) for k, v in fields.items()]).join(totals, "invoice").join(listed, "invoice")
    return out.select("*", *[text.money(F.col(c), CURRENCY).alias(f"{c}_text") for c in ("subtotal", "tax", "total")])


def with_upper_keys(values: Column) -> Column:
    """A map with every key in upper case too."""
    return F.map_concat(values, F.map_from_entries(F.transform(F.filter(F.map_entries(values), lambda e: F.upper(e["key"]) != e["key"]), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value")))))


def fill_template(templates: DataFrame, values: str = "values") -> DataFrame:
    """templates(text, values) with `filled`."""
    return templates.withColumn("filled", text.fill_placeholders(F.col("text"), with_upper_keys(F.col(values))))


def product_table(items: DataFrame) -> DataFrame:
    """The four columns of an invoice's table, in row order."""
    return items.select("invoice", "row_index", "description", "quantity", "unit_price", "total").orderBy("invoice", "row_index")
