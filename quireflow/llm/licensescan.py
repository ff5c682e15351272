"""License scans by canonical digest lookup. DataFrame functions only.

A text is brought to a canonical form: letters A-Z lowered, copyright notices (lines) dropped, equivalent
spellings replaced, punctuation and white space turned into single blanks. The SHA-256 of the entire canonical text is
joined to the digests of known licenses, which are canonicalised alike. Known licenses come with this package
(licenses/*.txt) or as a table of the caller's, and the licenses' titles may be there or not.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Punctuation beyond ASCII that stands for blanks.
MARKS = " «»‐‑‒–—―‘’“”•…　"
#: A line that opens with a copyright mark. (?m): lines; Java needs d too, for line ends to be \n alone.
COPYRIGHT = r"^[ \t]*(?:copyright|\(c\)|\x{A9})[^\n]*$"
#: Words that follow the mark where a line of wrapped prose begins with it.
PROSE = r"and|are|assignment|disclaimer|doctrines|holder|holders|if|in|interest|interests|is|law|laws|license|licenses|like|must|notice|notices|of|on|or|owner|owners|ownership|patent|permission|protection|rights|statement|statements|the(?:[ \t]+(?:library|software)|[ \t\r]*$)|those|to|treaty|under|you"
#: Of those lines, the notices: all but wrapped prose.
NOTICE = r"^[ \t]*(?:(?:copyright|\(c\))(?!(?:ed|able|s)(?![a-z0-9])|[^a-z0-9<\[{\x{A9}\n]*(?:$|(?:" + PROSE + r")(?![a-z0-9])))|\x{A9})[^\n]*$"
#: Runs of ASCII other than letters and digits.
BLANKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Equivalent spellings, after the matching guidelines for software licenses: fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("licence", "license"),
    ("modelling", "modeling"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("third parties", "thirdparties"),
)
#: Bound up to which known digests are broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """The canonical form of a text column: words with two blanks between, one at either end; null stays null."""
    t = F.translate(text.cast("string"), UPPER + MARKS, LOWER + " " * len(MARKS))
    t = F.regexp_replace(t, "(?dm)" + NOTICE, " ")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, BLANKS, "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return t


def canonical_text(text: str) -> str:
    """The same for a Python string."""
    t = text.translate(str.maketrans(UPPER + MARKS, LOWER + " " * len(MARKS)))
    t = re.sub(NOTICE.replace(r"\x{A9}", "\xa9"), " ", t, flags=re.M)
    t = f" {re.sub('[^a-z0-9\x80-\U0010ffff]+', '  ', t).strip(' ')} "
    for a, b in SPELLINGS:
        t = t.replace(f" {a.replace(' ', '  ')} ", f" {b} ")
    return t


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the licenses that come with this package; each with and without its first line if that is a
    title."""
    out = []
    for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = p.read_text(encoding="utf-8")
        out.append((p.stem, text))
        title, _, rest = text.partition("\n")
        if "License" in title and len(title) < 80:
            out.append((p.stem, rest))
    return out


def long_texts() -> list[tuple[str, str]]:
    """(license, text) of the long licenses of this package; each whole, and without what follows its terms."""
    out = []
    for p in sorted((Path(__file__).parent / "licenses" / "long").glob("*.txt")):
        text = p.read_text(encoding="utf-8")
        out.append((p.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(p.stem, terms), (p.stem, terms + end)]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known_texts() + long_texts()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def known_digests() -> list[tuple[str, str]]:
    """(license, digest) of known_texts(), without Spark."""
    return [(name, hashlib.sha256(canonical_text(t).encode()).hexdigest()) for name, t in known_texts()]


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(doc_id, digest, license) per row of docs: the digest of its entire canonical text, and the known license of
    that digest or null.

    A null text has neither. An empty text, or one of copyright lines and punctuation only, has the digest of a blank
    canonical form and no license, as blank forms are no known license. Of known licenses with equal digests the least
    name counts, so rows stay single. Rows may repeat, doc_id may be null; no rows give no rows; other columns are not
    read.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    forms = known.select("license", canonical(F.col("text")).alias("form")).where("length(trim(form)) > 0")
    digests = forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))
    if len(digests.limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    own = docs.select("doc_id", F.sha2(canonical(F.col(text)), 256).alias("digest"))
    return own.join(digests, "digest", "left").select("doc_id", "digest", "license")
