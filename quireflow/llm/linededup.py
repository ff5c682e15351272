"""Line dedup by content-defined line chunks. DataFrame functions only.

Lines are hashed; a rolling hash over the last `window` line hashes (a polynomial in FACTOR) ends a chunk where it is
0 modulo `divisor`, so inserted or lost lines move boundaries only nearby. Chunks of at least two lines are units. A
passage in few lines need not hold a whole chunk, so the shortest runs of lines of more than `long_words` words, one
from each line on and one up to each line, are units too: every repeated passage of so many words goes, to its first
and last line, whatever stands around it. A unit that occurs again anywhere, later in the order of doc_id and position,
is removed.

Units of equal hash are candidates; their bytes are compared. Runs overlap, so that their texts are many times the
documents': candidates of one pair of documents, as many lines apart, are put together, each line of theirs moves once,
and a unit is a copy if all of its lines are equal. With passages=False units are chunks and single lines of more than
`long_words` words, few enough to move as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quireflow.llm.common import cut, drop_table, free_shuffles

#: Production parameters: lines under the rolling hash, mean lines in a chunk, words of a passage in one line.
WINDOW, DIVISOR, LONG_WORDS = 2, 4, 50
#: Factor of the rolling hash; hexadecimal digits of a line's MD5 that make its hash.
FACTOR, DIGITS = 31, 7


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """A row's key: its doc_id (may be null) and its text's hash."""
    return docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64(F.col(text).cast("string")))


def runs_of(long_words: int) -> Column:
    """The shortest runs of lines that hold more than long_words words, one from each line on and one up to each line
    (lines without words begin and end none), out of `of`, the line of each word. Every repeated passage of more words
    is covered by them to its first and last line, whatever stands around it."""
    words = F.sequence(F.lit(0), F.size("of") - 1)
    at = lambda w: F.get("of", w)
    heads = F.filter(words, lambda w: (w + long_words < F.size("of")) & ((w == 0) | (at(w - 1) != at(w))))
    tails = F.filter(words, lambda w: (w >= long_words) & ((w == F.size("of") - 1) | (at(w + 1) != at(w))))
    span = lambda a, b: F.struct(at(a).alias("start"), (at(b) + 1).alias("stop"))
    both = F.concat(F.transform(heads, lambda w: span(w, w + long_words)), F.transform(tails, lambda w: span(w - long_words, w)))
    return F.when(F.size("of") > long_words, F.array_distinct(both)).otherwise(F.filter(both, lambda s: F.lit(False)))


def units_of(docs: DataFrame, text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS, passages: bool = True) -> DataFrame:
    """(_id, _h, start, stop, unit): units of each row as line numbers [start, stop) and their text. With passages, the
    runs of lines of runs_of() are units too."""
    lines = keyed(docs, text).where(F.col(text).isNotNull()).select("_id", "_h", F.split(F.col(text).cast("string"), "\n", -1).alias("lines"))
    hashes = lines.withColumn("hash", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, DIGITS), 16, 10).cast("long"))).withColumn("n", F.size("lines"))

    def rolling(i: Column) -> Column:
        """The rolling hash at line i."""
        out = F.lit(0).cast("long")
        for k in reversed(range(window)):
            out = out * FACTOR + F.get("hash", i - k)
        return out

    ends = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == F.col("n") - 1) | ((i >= window - 1) & (rolling(i) % divisor == 0)))
    cuts = hashes.withColumn("ends", ends)
    spans: Column = F.transform("ends", lambda e, i: F.struct(F.when(i > 0, F.get("ends", i - 1) + 1).otherwise(F.lit(0)).alias("start"), (e + 1).alias("stop")))
    chunks = F.filter(spans, lambda s: s["stop"] - s["start"] > 1)
    # only lines long enough to hold so many words are counted
    long_ = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("start"), (i + 1).alias("stop"), (F.length(x) > 2 * long_words).alias("long"), x.alias("x"))), lambda s: s["long"] & (F.regexp_count(s["x"], F.lit(r"[^\x20\x09-\x0D]+")) > long_words))
    if passages:  # a long line is a run by itself
        cuts = cuts.withColumn("of", F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))))))
        both = F.array_distinct(F.concat(chunks, runs_of(long_words)))
    else:
        both = F.concat(chunks, F.transform(long_, lambda s: F.struct(s["start"], s["stop"])))
    return cuts.select("_id", "_h", "lines", F.explode(both).alias("s")).select("_id", "_h", "s.start", "s.stop", F.array_join(F.slice("lines", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), "\n").alias("unit"))


def digest_of(unit: str) -> Column:
    """What tells candidates: equal bytes have equal digests, and few others have."""
    return F.xxhash64(unit, F.octet_length(unit))


def removals(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(_id, _h, gone): the line numbers that each row loses, rows that lose none left out."""
    units = units_of(docs, text, **how)
    if how.get("passages", True):
        return _gone(_copies(docs, text, units))
    digest = units.select("_id", "_h", "start", "stop", digest_of("unit").alias("digest"))
    place = F.struct("_id", "_h", "start", "stop")
    found = cut(digest, "units")
    counts = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = cut(counts.select("digest", "first"), "repeated")
    texts = units.withColumn("digest", digest_of("unit"))
    # texts of candidates only: each meets the first occurrence's text and is compared byte by byte
    met = cut(texts.join(again, "digest").select("digest", place.alias("place"), F.col("first"), "unit"), "candidates")
    # a table of its own: a join of two plain scans is one whose hot digests adaptive execution can split
    kept = cut(met.where("place = first").select("digest", F.col("unit").alias("kept")).dropDuplicates(["digest"]), "kept")
    same = met.where("place <> first").join(kept, "digest").where(F.col("unit").cast("binary") == F.col("kept").cast("binary"))
    # a unit of equal digest but other bytes is no copy of the first; such units are compared among themselves
    other = met.where("place <> first").join(kept, "digest").where(F.col("unit").cast("binary") != F.col("kept").cast("binary"))
    # (grouped by the unit alone: were the digest a key too, the join before would have to keep each digest in one task)
    rest = other.join(other.groupBy("unit").agg(F.min("place").alias("one")), "unit").where("place <> one")
    return _gone(same.select("place").unionByName(rest.select("place")))


def _copies(docs: DataFrame, text: str, units: DataFrame) -> DataFrame:
    """(place): all occurrences but the first, compared byte by byte."""
    place = F.struct("_id", "_h", "start", "stop")
    found = cut(units.select("_id", "_h", "start", "stop", digest_of("unit").alias("digest")), "units")
    again = cut(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first"), "repeated")
    met = found.join(again.hint("merge"), "digest").where(place != F.col("first"))
    # candidates of two documents that stand `shift` lines apart; a unit that meets one of other length is no copy
    span = F.struct("start", "stop", (F.col("stop") - F.col("start") == F.col("first.stop") - F.col("first.start")).alias("even"))
    shifts = met.groupBy("_id", "_h", F.col("first._id").alias("to_id"), F.col("first._h").alias("to_h"), (F.col("start") - F.col("first.start")).alias("shift")).agg(F.collect_set(span).alias("spans"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    regions = cut(shifts.withColumn("lines", lines).withColumn("region", F.monotonically_increasing_id()), "regions")
    drop_table(found)
    drop_table(again)
    free_shuffles(docs.sparkSession)
    # both documents of a region give its lines, in one join
    there = F.transform("lines", lambda i: i - F.col("shift"))
    asked = regions.select(F.col("_id").alias("_of_id"), F.col("_h").alias("_of_h"), "region", F.col("lines").alias("want"), "spans").unionByName(
        regions.select(F.col("to_id").alias("_of_id"), F.col("to_h").alias("_of_h"), "region", there.alias("want")), allowMissingColumns=True
    )
    rows = keyed(docs, text).select("_id", "_h", F.col(text).cast("string").alias("t"))
    joined = rows.join(asked.hint("merge"), F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_h") == F.col("_of_h")))
    # a lambda's variable holds the lines, so that they are split once
    own = F.get(F.transform(F.array(F.split("t", "\n", -1)), lambda x: F.transform("want", lambda i: F.get(x, i).cast("binary"))), 0)
    sides = joined.select("region", "_id", "_h", "want", "spans", own.alias("own"))
    here = F.max(F.when(F.col("spans").isNotNull(), F.struct("_id", "_h", "want", "spans", "own"))).alias("here")
    both = sides.groupBy("region").agg(here, F.max(F.when(F.col("spans").isNull(), F.col("own"))).alias("other"))
    differ = F.filter(F.col("here.want"), lambda i: ~F.coalesce(F.get("here.own", F.array_position("here.want", i).cast("int") - 1) == F.get("other", F.array_position("here.want", i).cast("int") - 1), F.lit(False)))
    # only where some line differs are lines looked at one by one
    told = both.withColumn("differ", F.when(F.col("here.own") == F.col("other"), F.filter(F.col("here.want"), lambda i: F.lit(False))).otherwise(differ))
    same = lambda s: s["even"] & ~F.exists("differ", lambda i: (i >= s["start"]) & (i < s["stop"]))
    compared = cut(told.select("here._id", "here._h", F.filter("here.spans", same).alias("same"), F.filter("here.spans", lambda s: ~same(s)).alias("others")), "compared")
    drop_table(regions)
    free_shuffles(docs.sparkSession)
    places = lambda c: compared.select("_id", "_h", F.explode(c).alias("s")).select(F.struct("_id", "_h", "s.start", "s.stop").alias("place"))
    copies = places("same")
    if compared.where(F.size("others") > 0).limit(1).count():
        # a unit of equal digest but other bytes is no copy of the first; such units are compared among themselves
        texts = units.select("_id", "_h", "start", "stop", "unit")
        wanted = places("others").select(*[F.col(f"place.{c}").alias(f"of_{c}") for c in ("_id", "_h", "start", "stop")])
        alike = F.col("_id").eqNullSafe(F.col("of__id"))
        for c in ("_h", "start", "stop"):
            alike &= F.col(c) == F.col(f"of_{c}")
        rest = texts.join(wanted, alike).select(place.alias("place"), "unit").distinct()
        copies = copies.unionByName(rest.join(rest.groupBy("unit").agg(F.min("place").alias("one")), "unit").where("place <> one").select("place"))
    return copies


def _gone(gone: DataFrame) -> DataFrame:
    """(_id, _h, gone) out of the places of units to remove."""
    return gone.groupBy("place._id", "place._h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("place.start"), F.col("place.stop") - 1))))).alias("gone"))


def marked(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with _id, _h and gone, the sorted numbers of the lines that a row loses (null: none). A merge join: lost grows with
    the input, and its arrays are far larger than its files."""
    lost = removals(docs, text, **how).hint("merge")
    rows = keyed(docs, text)
    return rows.join(lost.withColumnsRenamed({"_id": "_lost_id", "_h": "_lost_h"}), F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_h") == F.col("_lost_h")), "left").drop("_lost_id", "_lost_h")


def cleaned(text: str, gone: str = "gone") -> Column:
    """The text without the lines in gone, in time linear in its lines."""

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # a lambda's variable holds the lines, so that they are split once and not for each line
    split = F.transform(F.array(F.split(F.col(text).cast("string"), "\n", -1)), without)
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.get(split, 0))


def dedup_lines(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with repeated units removed from text, in the columns of docs; every row stays, if with an empty text.

    A null text stays null, an empty one empty. The first occurrence is that of the least doc_id (nulls first), then
    of the least text hash and line. Rows of equal id and text are one document: they lose the same lines. A unit
    that repeats within a document loses its later occurrences. No rows give no rows; other columns pass, whatever
    their names.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.lit(0).alias("_none"), *others).alias("_row"), F.col("doc_id"), F.col(text).alias("_text"))
    new = marked(packed, "_text", **how)
    return new.select(*[cleaned("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, lines_removed, n_bytes, text_sha256) of each row after dedup_lines(); nulls count as empty."""
    docs = docs.select("doc_id", F.col(text))
    new = marked(docs, text, **how).withColumn("_new", cleaned(text))
    lines = F.coalesce(F.size(F.split(F.col(text).cast("string"), "\n", -1)), F.lit(0))
    return new.select(F.col("_id").alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(lines).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("lines_removed"), F.octet_length(F.coalesce("_new", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("_new", F.lit("")), 256).alias("text_sha256"))
