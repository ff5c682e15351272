"""Text expressions: normal forms, tokens, edit distances, logical order, formatting.

All are native Column expressions but the Unicode normal forms, which Spark lacks: those run as a vectorised UDF on
texts that hold anything beyond ASCII only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

ARABIC = r"[\u0600-\u06FF]"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
TATWEEL = "\u0640"
# Letters that are folded, and the digits' ASCII forms.
FOLDED_FROM, FOLDED_TO = "إأآٱىئؤ", "ااااييو"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
TOKEN = r"([\u0600-\u06FF]+|[A-Za-z]+|(?U:\d)+(?:[./:-](?U:\d)+)*|(?U:\S))"
SPACE = r"(?U)\s+"


def _form(form: str):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.pandas_udf(run, "string")


def normal_form(text: Column, form: str = "NFKC") -> Column:
    """The text's Unicode normal form. ASCII is its own: such texts never leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _form(form)(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column, strip_diacritics: bool = True, normalize_digits: bool = True, lowercase: bool = False, punctuation_cleanup: bool = False, unicode: bool = True) -> Column:
    """The normal form that texts are compared in; null becomes empty. unicode: apply NFKC first (a UDF); callers that
    know their texts to be in that form already can leave it out."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = normal_form(t) if unicode else t
    t = F.replace(t, F.lit(TATWEEL), F.lit(""))
    if strip_diacritics:
        t = F.regexp_replace(t, DIACRITICS, "")
    t = F.translate(t, FOLDED_FROM, FOLDED_TO)
    if normalize_digits:
        t = F.translate(t, DIGITS_FROM, DIGITS_TO)
    if punctuation_cleanup:
        t = F.regexp_replace(F.regexp_replace(t, "[،؛؟]", " "), r"(?U)[^\w\s./:%+-]", " ")
    return squeeze(F.lower(t) if lowercase else t)


def tokenize(text: Column, strip_diacritics: bool = True, unicode: bool = True) -> Column:
    """Tokens of the normal form: runs of Arabic, runs of Latin letters, numbers with their separators, other signs."""
    return F.regexp_extract_all(normalize(text, strip_diacritics, unicode=unicode), F.lit(TOKEN), 1)


def normalize_field(text: Column, unicode: bool = True) -> Column:
    """NFC, white space collapsed, lower case."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.lower(squeeze(normal_form(t, "NFC") if unicode else t))


def _rate(distance: Column, length: Column, predicted: Column) -> Column:
    return F.when(length > 0, distance / length).otherwise(F.when(predicted > 0, 1.0).otherwise(0.0))


def cer(predicted: Column, truth: Column) -> Column:
    """Character error rate; against an empty truth 0 if the prediction is empty, else 1."""
    return _rate(F.levenshtein(predicted, truth), F.length(truth), F.length(predicted))


def token_distance(predicted: Column, truth: Column) -> Column:
    """Edit distance of two token arrays: each distinct token becomes one character of a supplementary private-use
    plane, so the built-in distance of strings does the work."""
    known = F.array_distinct(F.concat(predicted, truth))
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + F.lit(0xF0000)), 8, "0")), "UTF-32")
    word = lambda a: F.array_join(F.transform(a, letter), "")
    return F.levenshtein(word(predicted), word(truth))


def edit_distance(a, b, block: int = 1 << 13) -> int:
    """Edit distance of two sequences, exact at any length (Myers 1999, Hyyro 2003: a row of bits a step). Blocks of a are
    worked on one after the other, so memory follows len(b) and one block's masks, not the product."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    carry = [1] * len(b)  # horizontal differences along a block's upper edge; the first row counts up
    for start in range(0, len(a), block):
        part = a[start : start + block]
        full, top = (1 << len(part)) - 1, len(part) - 1
        where: dict = {}
        for i, x in enumerate(part):
            where[x] = where.get(x, 0) | 1 << i
        up, down = full, 0
        for j, x in enumerate(b):
            h, eq = carry[j], where.get(x, 0)
            xv = eq | down
            eq |= h < 0
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (full & ~(xh | up)), up & xh
            carry[j] = (ph >> top & 1) - (mh >> top & 1)
            ph, mh = (ph << 1 | (h > 0)) & full, (mh << 1 | (h < 0)) & full
            up, down = mh | (full & ~(xv | ph)), ph & xv
    return len(a) + sum(carry)


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def long_distance(predicted: Column, truth: Column) -> Column:
    """Edit distance of long texts, by characters, in workers; null if either is null."""
    return F.pandas_udf(_distances, "int")(predicted, truth)


def long_token_distance(predicted: Column, truth: Column) -> Column:
    """Edit distance of long token arrays, in workers: of any number of distinct tokens."""
    return F.pandas_udf(lambda a, b: _distances(a.map(lambda x: x if x is None else list(x)), b.map(lambda x: x if x is None else list(x))), "int")(predicted, truth)


def wer(predicted: Column, truth: Column) -> Column:
    """Token error rate of two token arrays, with the same convention for an empty truth."""
    return _rate(token_distance(predicted, truth), F.size(truth), F.size(predicted))


def words(text: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: F.length(w) > 0)


def char_distance_per_word(predicted: Column, truth: Column) -> Column:
    """Character distance divided by the truth's words, at least 1: what some evaluators report as word error rate."""
    return F.levenshtein(predicted, truth) / F.greatest(F.size(words(truth)), F.lit(1))


def char_error_ratio(predicted: Column, truth: Column) -> Column:
    """Character distance divided by the truth's length, at least 1."""
    return F.levenshtein(predicted, truth) / F.greatest(F.length(truth), F.lit(1))


def exact_match(predicted: Column, truth: Column, unicode: bool = True) -> Column:
    """1.0 if the lower-cased normal forms are equal, else 0.0."""
    return (normalize(predicted, lowercase=True, unicode=unicode) == normalize(truth, lowercase=True, unicode=unicode)).cast("double")


def edit_accuracy(predicted: Column, truth: Column) -> Column:
    """1 - distance / length of the truth, within 0..1; of an empty truth 1 if the prediction is empty, else 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - cer(predicted, truth))


def is_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def to_logical(text: Column, reverse_order: bool = True) -> Column:
    """Logical order of text stored in visual order: Arabic words reversed, and the order of words unless told not to."""
    turned = F.transform(words(text), lambda w: F.when(is_arabic(w), F.reverse(w)).otherwise(w))
    return F.array_join(F.reverse(turned) if reverse_order else turned, " ")


def reverse_text(text: Column) -> Column:
    """The whole text from its end, by code points."""
    return F.reverse(text)


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def field_of(label: Column) -> Column:
    """The field of a tag: what follows the first hyphen, or the tag itself."""
    return F.when(F.instr(label, "-") > 0, F.element_at(F.split(label, "-", 2), 2)).otherwise(label)


def strip_prefixes(label: Column) -> Column:
    """B- and I- removed wherever they stand."""
    return F.replace(F.replace(label, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit(""))


def money(amount: Column, currency: str) -> Column:
    """Two decimals and the currency; amounts are decimals, so halves round up."""
    return F.concat_ws(" ", amount.cast("decimal(18,2)").cast("string"), F.lit(currency))


def coordinates(values: Column) -> Column:
    """Coordinates with six decimals, joined by blanks."""
    return F.array_join(F.transform(values, lambda x: F.format_string("%.6f", x)), " ")


def with_brand(name: Column, brand: Column) -> Column:
    """The brand before the name, if it is Arabic and not part of the name already."""
    return F.when(F.coalesce(is_arabic(brand) & ~F.contains(name, brand), F.lit(False)), F.concat_ws(" ", brand, name)).otherwise(name)


def class_name(names: Column, class_id: Column) -> Column:
    """A class's name from a map, or its number."""
    return F.coalesce(F.try_element_at(names, class_id), class_id.cast("string"))


def stem(path: Column) -> Column:
    """A file name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """A file name's last suffix with its dot, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]+)$", 1))


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def field_colour(field: Column) -> Column:
    """Three channels 60..239 out of a field name's MD5."""
    digest = F.md5(field.cast("binary"))
    return F.array(*[F.lit(60) + F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("int") % 180 for i in range(3)])


def fill_placeholders(template: Column, values: Column) -> Column:
    """{{key}} replaced by the map's values."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
